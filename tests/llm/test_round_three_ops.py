"""URL filters, ranked search and vector codes on small tables, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arclet.llm import lexical_search, url_filter, vector_codes
from arclet.llm.queries import URL_RULES

# URL filters.

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/12/", "http://org/", "http://org", "http://x.org?/a", "http://notexample.org/es/",
    "http://example.com/fr/a", "http://m.example.com/de/b", "http://com/de/", "http://www.b.net:80/a//b/?utm_source=q&z=1&a=2#f", "https://B.net/a/b?a=2&z=1", "ftp://b.net/a/b?a=2", "x://y://z/p",
    "http://b.net/\u00e9\n?q", "http://b.net" + "/" * 5, "http://u@b.net:8080/", "http://" + "h" * 200_000 + "/" + "p" * 200_000,
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_canonical(url):
    host, path = plain_parts(url)
    host = re.sub(r":(80|443)?\Z", "", host.removeprefix("www."))
    if not host:
        return None
    path = re.sub("/+", "/", path)
    path = path.removesuffix("/")
    found = re.search(r"://[^?#]*\?([^#]*)", url)
    kept = sorted(p for p in (found[1].split("&") if found else []) if p and not re.match(url_filter.TRACKING, p))
    return host + path + ("?" + "&".join(kept) if kept else "")


def plain_verdict(url, listed, rules=URL_RULES):
    host, path = plain_parts(url)
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return max(fits)[1], max(fits)[2]
    return None, "block" if plain_canonical(url) in {plain_canonical(x) for x in listed} - {None} else "allow"


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_urls_are_judged_as_plain_python_does(spark):
    listed = ["http://b.net/a/b?z=1&a=2&ref=me", "https://www.y:/z", None, "nothing", "http://b.net/a/b?z=1&a=2&ref=me", "http://org/"]
    got = url_filter.judge_urls(pages(spark, URLS).withColumn("host", F.lit(1)).withColumn("canonical", F.lit(2)), pages(spark, listed), URL_RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert ((r.host, r.path), (r.rule, r.verdict)) == (plain_parts(URLS[r.page_id]), plain_verdict(URLS[r.page_id], listed)), URLS[r.page_id]
    verdicts = {r.page_id: r.verdict for r in got}
    assert verdicts[URLS.index("https://B.net/a/b?a=2&z=1")] == "block" and verdicts[URLS.index("ftp://b.net/a/b?a=2")] == "allow"


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_the_filter_loses_no_listed_url_and_the_join_drops_false_hits(spark, broadcast):
    rng = random.Random(5)
    known = [f"http://h{rng.randrange(400)}.net/{rng.randrange(10**6)}" for _ in range(3000)]
    others = [f"http://h{rng.randrange(400)}.net/x{rng.randrange(10**6)}" for _ in range(3000)]
    urls = known + others + known[:5] * 300
    # Two bits a URL let many others pass, so that the exact join has something to turn away.
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages(spark, urls), pages(spark, known), bits=2, broadcast_bytes=broadcast).collect()}
    assert [got[i] for i in range(len(urls))] == ["block"] * 3000 + ["allow"] * 3000 + ["block"] * 1500


def test_few_others_pass_the_filter(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h/"), F.col("id")).alias("canon"))
    blocks = url_filter.block_count(20_000)
    table = url_filter.bloom_blocks(keys, blocks)
    block, marks = url_filter._place(F.col("canon"), blocks)
    asked = spark.range(50_000).select(F.concat(F.lit("x/"), F.col("id")).alias("canon")).unionByName(keys).join(table, block == F.col("block"), "left")
    for i, m in enumerate(marks):
        asked = asked.where(F.call_function("shiftrightunsigned", F.col(f"w{i}"), m).bitwiseAND(F.lit(1).cast("long")) == 1)
    passed = Counter(r.kind for r in asked.select(F.substring("canon", 1, 1).alias("kind")).collect())
    assert passed["h"] == 20_000 and passed["x"] < 250


def test_url_rules_by_length_and_empty_tables(spark):
    rules = (("allow", "a.net", "/"), ("block", "a.net", "/x"), ("allow", "b.a.net", "/x"), ("block", "a.net", "/x"), ("allow", "a.net", "/x"))
    urls = ["http://a.net/", "http://a.net/x1", "http://c.b.a.net/x1", "http://ba.net/x", "http://b.a.net/y"]
    got = [(r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, urls), pages(spark, []), rules).orderBy("page_id").collect()]
    assert got == [("a.net/", "allow"), ("a.net/x", "block"), ("b.a.net/x", "allow"), (None, "allow"), ("a.net/", "allow")]
    assert url_filter.judge_urls(pages(spark, []), pages(spark, urls)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages(spark, urls), pages(spark, []), [("allow", "a", "/")] * 1001)


def test_urls_that_the_filter_turns_away_are_not_shuffled(spark):
    frame = url_filter.judge_urls(pages(spark, URLS), pages(spark, URLS[4:6]), URL_RULES)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("strategy=broadcast") == 2 and "Python" not in frame._jdf.queryExecution().executedPlan().toString()


# Ranked lexical search.


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(rows, items, top=10):
    """rows: (doc_id, text)."""
    docs = [(d, Counter(plain_terms(t))) for d, t in rows if plain_terms(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def found(spark, rows, items, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "terms", "item", "rank", "score")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.rank_documents(docs, asked, **how).collect()), key=repr)


def corpus(seed, n, words=300):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(f"W{w}" for w in rng.choice(words, rng.integers(1, 80), p=weights / weights.sum()))) for i in rng.permutation(n)]


@pytest.mark.parametrize("segment", [1 << 24, 4000, 1])
def test_search_gives_what_plain_scoring_does(spark, segment):
    rows = corpus(3, 600)
    rows += [(i + 10_000, rows[0][1]) for i in range(40)]  # ties
    items = [(i, t[:300]) for i, (_, t) in enumerate(corpus(4, 12))] + [(50, rows[0][1]), (51, "w1 w1 W1 w299"), (52, "absent"), (53, None), (54, "")]
    assert found(spark, rows, items, segment_bytes=segment) == plain_search(rows, items)
    assert found(spark, rows, items, segment_bytes=segment, top=1) == plain_search(rows, items, 1)


def test_search_of_odd_texts_ids_and_tables(spark):
    rows = [(1, "\u00c9cole \u00e9COLE x_y-z9"), (None, "x y"), (None, "x y"), (3, "x y"), (3, "x y"), (4, None), (5, " \n.,"), (-7, "x y"), (8, "a\u00a0b \u3000 K\u212a k"), (9, "\x00x\x7fy"), (10, "word " * 400_000 + "needle")]
    items = [(0, "x Y"), (None, "needle \u00e9cole"), (2, "a\u00a0b"), (3, "\u212a k word"), (4, "...")]
    assert found(spark, rows, items, segment_bytes=64) == plain_search(rows, items)
    # Repeated rows of items count once.
    assert found(spark, rows, [*items, *items]) == plain_search(rows, items)
    assert found(spark, [], items) == [] and found(spark, rows, []) == [] and found(spark, [(1, None)], items) == []


def test_items_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS_A_PASS", 5)
    rows, items = corpus(8, 80), [(i, t) for i, t in corpus(9, 12)]
    assert found(spark, rows, items) == plain_search(rows, items)


def test_postings_are_packed_and_unpacked():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 5])
    raw, ends = lexical_search.packed(v)
    assert (lexical_search.unpacked(raw) == v).all() and ends[0] == 1 and ends[3] == 5 and len(raw) == ends[-1]
    assert lexical_search.unpacked(lexical_search.packed(v[:0])[0]).size == 0


def test_texts_are_parted_in_slices_too():
    texts = pa.array(["A b", "", None, " c1\u00e9,D ", "x"])
    for a in range(5):
        n, terms = lexical_search.parted(texts.fill_null("").slice(a))
        want = [plain_terms(t) for t in texts.to_pylist()[a:]]
        assert n.tolist() == [len(w) for w in want] and terms.to_pylist() == [t for w in want for t in w]


# Vector codes.


def plain_codes(rows, rounds=2, parts=16, entries=64):
    """rows: (vec_id, embedding, label), all whole and of one length."""
    v = [[math.floor(256 * x) for x in r[1]] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))
    d = len(v[0]) // parts
    cut = lambda x, p: x[p * d : (p + 1) * d]
    books = [[cut(v[i], p) for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (far(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(x, p) for p in range(parts)] for x in v]
        for p in range(parts):
            new = []
            for e in range(len(books[p])):
                own = [cut(x, p) for x, c in zip(v, codes) if c[p] == e]
                new.append([sum(c) // len(own) for c in zip(*own)] if own else books[p][e])
            books[p] = new
    out, total = {}, Counter()
    for i, x in enumerate(v):
        c = [near(x, p) for p in range(parts)]
        error = sum(far(cut(x, p), books[p][c[p]]) for p in range(parts))
        out[i] = ("".join(f"{e:02x}" for e in c), error)
        total[rows[i][2]] += error
    flat = ",".join(str(x) for p in books for e in p for x in e)
    return [(rows[i][0], *out[i], total[rows[i][2]], hashlib.sha256(flat.encode()).hexdigest()) for i in range(len(rows))]


SCHEMA = "vec_id long, embedding array<float>, label int"


def coded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "code": F.lit("x"), "error": F.lit(2), "x": F.lit(0), "part": F.lit(0)})
    return sorted((tuple(r) for r in vector_codes.compress_vectors(df).collect()), key=repr)


@pytest.mark.parametrize("width,scale", [(1, 1.0), (4, 0.3), (5, 1000.0)])
def test_codes_are_those_of_plain_rounds(spark, width, scale):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, scale, 16 * width)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(150)]
    rows += [(i + 500, rows[0][1], 9) for i in range(60)] + [(rows[3][0], rows[5][1], 1), (None, rows[6][1], 2)]
    assert coded(spark, rows) == sorted(plain_codes(rows), key=repr)


def test_vectors_that_are_not_whole_go_and_odd_ones_keep_their_row(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.integers(-300, 300, 16) / 256], i % 2) for i in range(10)]
    gone = [(20, None, 1), (21, [None] + [0.0] * 15, 1), (22, [math.nan] + [0.0] * 15, 1), (23, [math.inf] + [0.0] * 15, 1), (24, [0.0] * 15 + [-math.inf], 1)]
    odd = [(-1, [], 5), (30, [1.0] * 15, 5), (31, [1.0] * 32, None), (32, [1e30] * 16, 1)]
    got = coded(spark, good + gone + odd)
    want = plain_codes(good)
    sha, total = want[0][4], {r[2]: w[3] for r, w in zip(good, want)}
    assert got == sorted([*want, *[(i, None, None, total.get(label), sha) for i, _, label in odd]], key=repr)
    assert coded(spark, gone) == [] and coded(spark, []) == []
    assert [r[:4] for r in coded(spark, odd[:1])] == [(-1, None, None, None)]


@pytest.mark.parametrize("size", [3, 300, 40_000, vector_codes.LIMIT])
def test_screening_leaves_the_nearest_entry_in(size):
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size, (64, 6))
    c[40:] = c[:24] + rng.integers(0, 2, (24, 6))  # near and exact ties
    x = np.concatenate((rng.integers(-size, size, (500, 6)), c, np.repeat(c[:3], 5, axis=0)))
    exact = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    code, far = vector_codes.nearest(x, c)
    assert code.tolist() == exact.argmin(axis=1).tolist() and far.tolist() == exact.min(axis=1).tolist()
    low, high = vector_codes.intervals(x, c)
    value = exact - (x.astype(object) ** 2).sum(axis=1)[:, None]
    assert (value >= low).all() and (value <= high).all()
