"""Exact Jaccard self-join on word shingles that skips by position and by what is known of a similar set.

Sets are ordered by one global order (frequent shingles last, else by hash), and two sets can only link if their
prefixes share a shingle. The lists of sets by prefix shingle are the index. Of two sets that can link by a list the
smaller holds the shingle early enough to link with a set of its own size; lists without such a set go, and with them
members too late for the smallest one. Pairs are compared in three rounds:

1.  Every list has a centre, the smallest set that is early enough. Members are verified against it, and linked ones merge.
2.  Answers already known for the centre then serve its list: members of one component need no further link, and two
    members whose distances to the centre differ by more than the radius can't link (Jaccard distance is a metric).
    What remains is bounded block by block; a block whose sizes or positions leave too little overlap is skipped. Of the
    pairs that are left in a list those of a spanning forest of its components, nearest first, are verified and merge.
3.  Lists with more such pairs than their forests hold are taken again, and all pairs whose components are still apart
    are verified, each in the first list that it meets in.

Before texts are touched, parity sketches of the sets bound a pair's symmetric difference from below, and so its
similarity from above. So a group of m near copies costs about m comparisons a list and not m squared, and no link
between components is lost. Equal sets are one node, told from others by two digests of 64 bits; shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, share_code, shingle_sets, stored, text_frame
from .components import connected_components

#: Shingles that are held to be frequent on the way to the order; more only make the order worse, never a result.
MAX_FREQUENT = 1 << 20
#: Hashes that a Python worker counts together, and how often one must be among them to count at all.
MOST_COUNTED = 1 << 21
BATCH_LEAST = 3
#: Longer lists are dealt out as pairs of chunks of about this many members.
LIST_CHUNK = 8192
#: Members of lists this long bring their sketches, so that pairs are bounded where they are met.
SKETCH_FROM = 8
#: Pairs that a Python worker gathers before it hands them on.
MOST_PAIRS = 1 << 16
#: Hashes that a Python worker gathers before it hands them on.
MOST_HELD = 1 << 19
#: Members that a skipped or compared block holds.
BLOCK = 256
#: Shingles before a list's own that a member brings: two members that share one have met there.
BEFORE = 4


def sketch(h: np.ndarray) -> bytes:
    """For each of two to four times as many buckets as hashes, whether an odd number of hashes falls into it."""
    m = 1 << max(6, int(2 * len(h) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their sketches."""
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def folded(a: bytes, words: int) -> np.ndarray:
    """A sketch of fewer buckets, from one of more."""
    x = np.frombuffer(a, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def digest_of(s: np.ndarray) -> int:
    """A second digest of a set, of which the first says nothing."""
    return int(mixed(np.add.reduce(mixed(s ^ np.uint64(0xC2B2AE3D27D4EB4F)), keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def node_of(s: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """A set's name; shared: digests that stand for more than one set, which then bear a name of both digests."""
    own = int(mixed(np.add.reduce(s * (s | np.uint64(1)), keepdims=True) ^ np.uint64(len(s)))[0].view(np.int64))
    return own ^ digest_of(s) if own in shared else own


def _sets(k):
    def counted(often):
        values, counts = np.unique(np.concatenate(often), return_counts=True)
        some = counts >= BATCH_LEAST
        return pd.DataFrame({"kind": np.int8(1), "doc_id": values[some].view(np.int64), "n": counts[some].astype(np.int64), "node": 0, "second": 0, "sketch": None})

    def run(batches):
        often, held = [], 0
        for pdf in batches:
            ids, sizes, nodes, seconds, sketches = [], [], [], [], []
            for i, s in zip(pdf["doc_id"], shingle_sets(pdf["text"], k)):
                ids.append(i)
                sizes.append(len(s))
                nodes.append(node_of(s))
                seconds.append(digest_of(s))
                sketches.append(sketch(s))
                often.append(s)
                held += len(s)
                if held > MOST_COUNTED:
                    yield counted(often)
                    often, held = [], 0
            yield pd.DataFrame({"kind": np.int8(0), "doc_id": pd.array(ids, "Int64"), "n": sizes, "node": nodes, "second": seconds, "sketch": sketches})
        if often:
            yield counted(often)

    return run


def _prefixes(k, percent, frequent, shared):
    """frequent: sorted hashes; they come last in the order of a set."""

    def run(batches):
        for pdf in batches:
            out, size, done = {"token": [], "node": [], "n": [], "pos": []}, 0, set()
            for s in shingle_sets(pdf["text"], k):
                n, node = len(s), node_of(s, shared)
                if not n or node in done:
                    continue
                done.add(node)
                if frequent.size:
                    at = np.minimum(np.searchsorted(frequent, s), frequent.size - 1)
                    last = frequent[at] == s
                    if last.any():
                        s = np.concatenate((s[~last], s[last]))
                p = n - (percent * n + 99) // 100 + 1
                out["token"].append(s[:p].view(np.int64))
                out["node"].append(np.full(p, node, np.int64))
                out["n"].append(np.full(p, n, np.int32))
                out["pos"].append(np.arange(p, dtype=np.int32))
                size += p
                if size > MOST_HELD:
                    yield pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})
                    out, size = {c: [] for c in out}, 0
            if out["n"]:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    return run


def _lists(batches):
    """Rows sorted by token and further columns -> the distinct ones of lists of two and more, with the list's first as centre, its
    size and place."""
    seen, centre, held = None, None, None
    for pdf in batches:
        if not len(pdf):
            continue
        t, ids = pdf["token"].to_numpy(), pdf["node"].to_numpy()
        again = np.zeros(len(t), bool)
        again[1:] = (t[1:] == t[:-1]) & (ids[1:] == ids[:-1])
        again[0] = seen == (t[0], ids[0])
        seen_token, seen = seen[0] if seen else None, (t[-1], ids[-1])
        pdf, t, ids = pdf[~again], t[~again], ids[~again]
        if not len(t):
            continue
        starts = np.concatenate(([True], t[1:] != t[:-1]))
        starts[0] = seen_token != t[0]
        heads = np.flatnonzero(starts)
        which = np.cumsum(starts) - 1
        own = np.column_stack([pdf[c].to_numpy() for c in ("node", "n", "pos")])
        # Rows before the first start belong to the list that the last batch ended with.
        centres = own[heads[np.maximum(which, 0)]] if heads.size else np.zeros((len(t), 3), np.int64)
        if centre is not None:
            centres[which < 0] = centre
        out = pdf[["token", "node", "n", "pos"]].assign(centre=centres[:, 0], cn=centres[:, 1], cpos=centres[:, 2])
        # A list of one shows only when the next list starts: its row is held back until then.
        alone = starts & np.concatenate((starts[1:], [False]))
        if held is not None and not starts[0]:
            yield held
        held = None
        if starts[-1]:
            held = out.iloc[-1:]
            alone[-1] = True
        if (~alone).any():
            yield out[~alone]
        centre = centres[-1]


def spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j) make the least spanning forest of the labels: each tree takes its nearest edge, round by round."""
    order = np.argsort(far, kind="stable")
    root = np.unique(label, return_inverse=True)[1]
    trees = int(root.max()) + 1
    u, v, rank, kept = root[i[order]], root[j[order]], np.arange(len(order)), []
    while (apart := u != v).any():
        u, v, rank = u[apart], v[apart], rank[apart]
        # Ranks are unique, so that nearest edges close no ring but that of two trees with one edge.
        best = np.full(trees, len(u))
        np.minimum.at(best, u, np.arange(len(u)))
        np.minimum.at(best, v, np.arange(len(u)))
        at = np.flatnonzero(best < len(u))
        edge = best[at]
        kept.append(rank[np.unique(edge)])
        up = np.arange(trees)
        up[at] = np.where(u[edge] == at, v[edge], u[edge])
        ring = (up[up] == np.arange(trees)) & (np.arange(trees) < up)
        up[ring] = np.flatnonzero(ring)
        while (up[up] != up).any():
            up = up[up]
        u, v = up[u], up[v]
    return order[np.concatenate(kept)] if kept else order[:0]


def _crossing(percent, forest):
    """Rows sorted by token, lo, hi, n, node with label and bounds of the distance to the centre -> pairs that may link.

    forest: of lists with sketches, only a spanning forest of their labels. Where that leaves pairs out, more is true and token the list's, else 0.
    """
    radius = 1 - percent / 100 + 1e-9

    def within(n, pos, ids, least, most, label, chunk, sketches, before):
        split = chunk.min() != chunk.max()
        rest = n - pos
        for start in range(0, len(n), BLOCK):
            a = slice(start, min(start + BLOCK, len(n)))
            # Sizes ascend: only partners of at most n / threshold words from here on.
            stop = np.searchsorted(n, n[a][-1] * 100 // percent, side="right")
            for other in range(start, stop, BLOCK):
                b = slice(other, min(other + BLOCK, stop))
                need = -(-percent * (int(n[a][0]) + int(n[b][0])) // (100 + percent))
                if min(int(rest[a].max()), int(rest[b].max())) < need:
                    continue
                if label[a][0] == label[b][0] and (label[a] == label[a][0]).all() and (label[b] == label[a][0]).all():
                    continue
                na, nb = n[a][:, None], n[b][None, :]
                ok = label[a][:, None] != label[b][None, :]
                ok &= (least[a][:, None] - most[b][None, :] <= radius) & (least[b][None, :] - most[a][:, None] <= radius)
                ok &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                ok &= np.minimum(rest[a][:, None], rest[b][None, :]) * (100 + percent) >= percent * (na + nb)
                if split:
                    ok &= chunk[a][:, None] != chunk[b][None, :]
                x, y = np.nonzero(ok)
                if other == start:
                    x, y = x[x < y], y[x < y]
                far = None
                if x.size and before is not None:
                    p, q = before[a][x], before[b][y]
                    fresh = ~((p[:, :, None] == q[:, None, :]) & (p != 0)[:, :, None]).any(axis=(1, 2))
                    x, y = x[fresh], y[fresh]
                if x.size and sketches[a][0] is not None:
                    words = min(min(map(len, sketches[a])), min(map(len, sketches[b]))) // 8
                    p, q = (np.stack([folded(t, words) for t in sketches[c]]) for c in (a, b))
                    apart = np.maximum(np.bitwise_count(p[x] ^ q[y]).sum(axis=1, dtype=np.int64), np.abs(n[a][x] - n[b][y]))
                    sizes = n[a][x] + n[b][y]
                    may = 100 * (sizes - apart) >= percent * (sizes + apart)
                    x, y, far = x[may], y[may], (apart / sizes)[may]
                if x.size:
                    yield start + x, other + y, far

    def chosen(rows):
        order = np.argsort(rows[0], kind="stable")
        rows = [x[order] for x in rows]
        ids, label, sketches, before = rows[2], rows[5], rows[7], rows[8]
        rows[8] = None if forest or before[0] is None else np.stack(before)
        held, all_of = None, 0
        for i, j, far in within(*rows):
            if not forest or sketches[0] is None:
                yield ids[i], ids[j], False
                continue
            all_of += len(i)
            held = (i, j, far) if held is None else tuple(map(np.concatenate, zip(held, (i, j, far))))
            if len(held[0]) > MOST_PAIRS:
                held = tuple(x[spanning(label, *held)] for x in held)
        if held is not None:
            tree = spanning(label, *held)
            yield ids[held[0][tree]], ids[held[1][tree]], len(tree) < all_of

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf[["token", "lo", "hi"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], cut))
            yield from pairs(pdf, bounds)
            held = pdf.iloc[bounds[-1] :]
        if held is not None:
            yield from pairs(held, np.array([0, len(held)]))

    def pairs(pdf, bounds):
        cols = [pdf[c].to_numpy() for c in ("n", "pos", "node", "least", "most", "label", "chunk", "sketch", "before")]
        token, found, size = pdf["token"].to_numpy(), [], 0
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1 and (cols[5][s:e] != cols[5][s]).any():
                for a, b, more in chosen([c[s:e] for c in cols]):
                    found.append((np.minimum(a, b), np.maximum(a, b), np.full(len(a), token[s]), np.full(len(a), more)))
                    size += len(a)
                    if size > MOST_PAIRS:
                        yield frame(found)
                        found, size = [], 0
        if found:
            yield frame(found)

    def frame(found):
        a, b, token, more = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a, "b": b, "token": np.where(more, token, 0), "more": more}).drop_duplicates()

    return run


def _sketched(percent):
    """Pairs with sizes and sketches -> a, b, least (a bound of the distance), open (whether the pair may link)."""

    def run(batches):
        for pdf in batches:
            apart = np.array([sketch_distance(x, y) for x, y in zip(pdf["sa"], pdf["sb"])], np.int64)
            sizes = pdf["na"].to_numpy() + pdf["nb"].to_numpy()
            apart = np.maximum(apart, np.abs(pdf["na"].to_numpy() - pdf["nb"].to_numpy()))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "least": 2 * apart / np.maximum(sizes + apart, 1), "open": 100 * (sizes - apart) >= percent * (sizes + apart)})

    return run


def _hashed(k, shared):
    def run(batches):
        for pdf in batches:
            ids, sets, size = [], [], 0
            for s in shingle_sets(pdf["text"], k):
                ids.append(node_of(s, shared))
                sets.append(s.view(np.int64))
                size += len(s)
                if size > MOST_HELD:
                    yield pd.DataFrame({"node": ids, "shingles": sets})
                    ids, sets, size = [], [], 0
            if ids:
                yield pd.DataFrame({"node": ids, "shingles": sets})

    return run


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes -> a, b, least, open, by sketches."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return stored(both.mapInPandas(_sketched(percent), "a long, b long, least double, open boolean"))


def _met(rows: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Members of lists, with labels -> a, b, token, more (see _crossing()): pairs of members of two labels that may link."""
    many = rows.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("m")).where("l < h")
    rows = rows.join(many.select("token", "m", F.ceil(F.col("m") / LIST_CHUNK).cast("int").alias("g")), "token")
    long = rows.where(F.col("m") >= SKETCH_FROM)
    none = F.lit(None).cast("array<long>")
    order = Window.partitionBy("node").orderBy("pos")
    # The place of a shingle in a set tells which ones are before it; a pair that shares one of those meets in its list too.
    long = long.withColumn("before", none if forest else F.array(*(F.lag("token", i, 0).over(order) for i in range(1, BEFORE + 1))))
    long = long.join(nodes.select("node", "sketch"), "node")
    rows = long.unionByName(rows.where(F.col("m") < SKETCH_FROM).withColumn("before", none).withColumn("sketch", F.lit(None).cast("binary")))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), "g").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumn("lo", F.least("chunk", "with")).withColumn("hi", F.greatest("chunk", "with"))
    rows = rows.select("token", "lo", "hi", "node", "n", "pos", "least", "most", "label", "chunk", "sketch", "before")
    rows = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "node")
    return rows.mapInPandas(_crossing(percent, forest), "a long, b long, token long, more boolean")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, shared: frozenset[int]) -> DataFrame:
    """Pairs (a, b) of nodes -> a, b, both (intersection), total (union). Sets are made of one text of each node only."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # As a table of its own the list of documents has a known size: while it is small it goes to the texts, beyond that texts are shuffled.
    heads = stored(nodes.join(ids, "node", "left_semi").select("doc_id"))
    sets = stored(docs.join(heads, "doc_id", "left_semi").mapInPandas(_hashed(k, shared), "node long, shingles array<long>").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("sizes"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return stored(both.select("a", "b", "both", (F.col("sizes") - F.col("both")).alias("total")))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75):
    """(members, links): members has doc_id, n_shingles and node, equal for equal sets; links has pairs (a, b) of nodes with
    both and total, enough of them to reach every node that links reach.

    Documents link when 100 * intersection >= percent * union of their sets of k-word shingles. Null or blank texts have
    the empty set and no node. Rows that share a doc_id each have their own set. Texts are read whole, three or four times;
    a set is held for one text at a time and written, once, for texts that may link.
    """
    spark = df.sparkSession
    share_code(spark)
    docs = text_frame(df, id_col, text_col)
    seen = stored(docs.mapInPandas(_sets(k), "kind byte, doc_id long, n long, node long, second long, sketch binary"))
    # Of n sets about n * n / 2 ** 65 pairs have one digest: with 10 ** 10 sets 3. Both digests then make their names.
    twins = seen.where("kind = 0 and n > 0").groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low < high")
    shared = frozenset(r.node for r in twins.select("node").collect())
    if shared:
        two = F.col("node").isin(*shared)
        seen = seen.withColumn("node", F.when(two, F.col("node").bitwiseXOR(F.col("second"))).otherwise(F.col("node")))
    members = seen.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    counts = seen.where("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("n"))
    # The order's tail: a bounded list of the most frequent shingles, by the least count that keeps the list within its bound.
    counts = stored(counts)
    least, listed = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).limit(100_000).collect():
        listed += r.m
        if listed > MAX_FREQUENT:
            break
        least = r.n
    top = counts.where(F.col("n") >= F.lit(least)).select("token").toArrow()
    frequent = np.sort(top["token"].to_numpy().astype(np.int64).view(np.uint64))
    # One document of each set: the smallest. Sketches of equal sets are equal.
    nodes = seen.where("kind = 0 and n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    nodes = stored(nodes)

    entries = docs.where("doc_id is not null").mapInPandas(_prefixes(k, percent, frequent, shared), "token long, node long, n int, pos int")
    # Of two members that can link by a list the smaller one is early: it could link with a set of its own size.
    late = lambda n, pos: f"{100 + percent}L * ({n} - {pos}) < {2 * percent}L * {n}"
    ordered = entries.withColumn("late", F.expr(late("n", "pos"))).repartition("token").sortWithinPartitions("token", "late", "n", "node")
    lists = ordered.mapInPandas(_lists, "token long, node long, n int, pos int, centre long, cn int, cpos int")
    useful = f"not ({late('n', 'pos')}) or (cn < n and {100 + percent}L * (n - pos) >= {percent}L * (n + greatest(cn, {percent}L * n div 100)))"
    lists = stored(lists.where(f"not ({late('cn', 'cpos')})").where(useful))
    fits = f"100 * least(n, cn) >= {percent} * greatest(n, cn) and {100 + percent} * least(n - pos, cn - cpos) >= {percent} * (n + cn)"
    first = lists.where(f"node <> centre and {fits}").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    bounds = _bounded(first, nodes, percent)
    links = _verified(bounds.where("open").select("a", "b"), nodes, docs, k, shared)
    linked = F.expr(f"100 * both >= {percent} * total")
    named = lambda x: connected_components(x.where(linked)).select(F.col("id").alias("node"), F.col("component").alias("label"))

    # What is known of a member and a centre holds for all lists that have both: it is put together once, and lists meet it once.
    exact = links.select("a", "b", (1 - F.col("both") / F.col("total")).alias("far"))
    known = bounds.join(exact, ["a", "b"], "left").select("a", "b", F.coalesce("far", "least").alias("least"), F.coalesce("far", F.lit(1.0)).alias("most"))
    known = known.select(F.col("a").alias("node"), F.col("b").alias("centre"), "least", "most").union(known.select("b", "a", "least", "most"))
    apart = F.when(F.col("node") == F.col("centre"), 0.0)
    least = F.coalesce(apart, "least", 1 - F.least("n", "cn") / F.greatest("n", "cn"))
    info = lists.select("node", "centre", "n", "cn").distinct().join(known, ["node", "centre"], "left").join(named(links), "node", "left")
    info = stored(info.select("node", "centre", least.alias("least"), F.coalesce(apart, "most", F.lit(1.0)).alias("most"), F.coalesce("label", "node").alias("label")))
    rows = stored(lists.select("token", "node", "centre", "n", "pos").join(info, ["node", "centre"]).drop("centre"))

    tried = bounds.select("a", "b")
    met = stored(_met(rows, nodes, percent, forest=True))
    second = stored(met.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(_bounded(second, nodes, percent).where("open").select("a", "b"), nodes, docs, k, shared))
    left = stored(met.where("more").select("token").distinct())
    if left.isEmpty():
        return members, links.where(linked)
    rows = rows.drop("label").join(left, "token", "left_semi").join(named(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    third = _met(stored(rows), nodes, percent, forest=False).select("a", "b").distinct()
    third = stored(third.join(tried.union(second), ["a", "b"], "left_anti"))
    return members, links.unionByName(_verified(_bounded(third, nodes, percent).where("open").select("a", "b"), nodes, docs, k, shared)).where(linked)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest doc_id that links and equal sets reach, its own
    without a set). Rows of null doc_id get the component of their set, if another row has it."""
    members, links = jaccard_links(df, id_col, text_col, k, percent)
    # Tables of their own, so that joins with a large class or component split under adaptive execution.
    reach = stored(connected_components(links).withColumnRenamed("id", "node").withColumnRenamed("component", "group"))
    rows = members.join(reach, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = stored(rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")))
    return rows.join(least, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
