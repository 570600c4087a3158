"""Ranked lexical search over shards of compressed postings.

A shard holds the documents of one task's segment, about SEGMENT_BYTES of text, in ascending order of doc_id: their ids and
lengths, its terms in order, and of each term its postings, gaps and counts as variable-length bytes. Shards are rows of a table
in the shared folder; making them shuffles no text, and a lost task makes its own again.

A query goes through a shard's documents one at a time, in order: a heap of the next posting of each list gives the next document,
all its terms add up, and a bounded heap keyed by score, then doc_id, keeps the best. Lists whose largest shares together stay
under the least kept score can't bring in a document by themselves (the public MaxScore rule): they leave the heap and are
looked up only for documents that the others have named. What is kept goes on to the task's next shard; then all tasks' results
meet and the best of each item stay.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import share_code, stored, text_frame

TOP = 10
#: Text that one shard holds, about; a document is never parted.
SEGMENT_BYTES = 8 << 20
#: What one pass over the shards looks for at most: items, and terms of all of them together. More take more passes.
ITEMS_A_PASS = 2048
TERMS_A_PASS = 200_000
#: Of bytes: letters and digits of ASCII, small, and all bytes of other characters; the rest part terms.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "shard long, doc_ids array<long>, lengths array<int>, terms array<string>, holders array<int>, ends array<long>, postings binary"


def terms_of(text: str) -> list[str]:
    """The terms of one text, in order."""
    return [t.decode("utf-8", "replace") for t in text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()]


def parted(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Of each text its number of terms, and all terms in order. Texts are parted where their bytes lie, all at once."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    plain = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(_PLAIN) if data else b""
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(plain)))
    found = lists.flatten()
    # A gap before the first term or after the last makes an empty one.
    some = pc.not_equal(pc.binary_length(found), 0)
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return np.diff(before[ends]), found.filter(some)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits, low ones first, the last with its high bit clear; and where each ends."""
    size = np.ones(values.size, np.int64)
    rest = values >> 7
    while rest.any():
        size += rest > 0
        rest = rest >> 7
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if ends.size else 0, np.uint8)
    for k in range(int(size.max()) if size.size else 0):
        some = size > k
        out[(ends - size)[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    if not raw.size:
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(raw.size) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


class Shard:
    """Documents that become one shard."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.terms: list[pa.StringArray] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: pa.StringArray) -> None:
        n, terms = parted(texts)
        self.ids.append(ids.filter(pa.array(n > 0)))
        self.lengths.append(n[n > 0])
        self.terms.append(terms)
        self.size += texts.nbytes

    def row(self, shard: int) -> pa.RecordBatch:
        # Numbers of documents follow their ids, nulls last; those of terms their bytes.
        ids, lengths = pa.chunked_array(self.ids), np.concatenate(self.lengths)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        every = pa.concat_arrays(self.terms).dictionary_encode()
        by_name = pc.sort_indices(every.dictionary)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name.to_numpy()] = np.arange(len(by_name))
        pair = rank[every.indices.to_numpy()] * len(order) + np.repeat(place, lengths)
        pair.sort()
        new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        times = np.diff(np.append(new, pair.size))
        term, doc = np.divmod(pair[new], len(order))
        first = np.concatenate(([True], term[1:] != term[:-1]))
        gap = np.where(first, doc, doc - np.concatenate(([0], doc[:-1])))
        raw, ends = packed(np.column_stack((gap, times)).ravel())
        holders = np.diff(np.append(np.flatnonzero(first), term.size))
        whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values)
        columns = [
            pa.array([shard]), whole(ids.take(pa.array(order)).combine_chunks(), None), whole(lengths[order], pa.int32()), whole(every.dictionary.take(by_name), None),
            whole(holders, pa.int32()), whole(ends[2 * np.cumsum(holders) - 1], pa.int64()), pa.array([raw.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "doc_ids", "lengths", "terms", "holders", "ends", "postings"])


def _shards(segment_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        # Unique over tasks, and the same if a task runs again.
        at, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            shard.add(batch.column("doc_id"), batch.column("text"))
            if shard.size >= segment_bytes and sum(map(len, shard.ids)):
                yield shard.row(at)
                at, shard = at + 1, Shard()
        if sum(map(len, shard.ids)):
            yield shard.row(at)

    return run


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The shards of df's documents, written to the shared folder; of documents without a term there is nothing to find."""
    share_code(df.sparkSession)
    return stored(text_frame(df, id_col, text_col).where("text is not null").mapInArrow(_shards(segment_bytes), INDEX))


class Postings:
    """Of the terms asked for, one shard's lists, unpacked when first wanted."""

    def __init__(self, batch, row: int, asked: pa.StringArray, weights: np.ndarray, n_docs: int, n_terms: int):
        part = lambda c: batch.column(c)[row]
        self.ids = part("doc_ids").as_py()
        lengths = part("lengths").values.to_numpy().astype(np.int64)
        self.norm = 8 * (25 + 75 * lengths * n_docs // n_terms)
        self.raw, self.ends = np.frombuffer(part("postings").as_py(), np.uint8), part("ends").values.to_numpy()
        self.place = pc.fill_null(pc.index_in(asked, value_set=part("terms").values), -1).to_pylist()
        self.weights, self.have = weights, {}

    def list(self, term: int, times: int):
        """Numbers of documents, what the term, asked for so many times, adds to each, as an array and as a list, and the largest
        of these; None where no document holds it, or where it adds nothing."""
        if (term, times) not in self.have:
            i = self.place[term]
            self.have[term, times] = None
            if i >= 0 and self.weights[term]:
                doc, n = unpacked(self.raw[self.ends[i - 1] if i else 0 : self.ends[i]]).reshape(-1, 2).T
                doc = np.cumsum(doc)
                adds = times * self.weights[term] * (1_000_000_000 * n // (1000 * n + self.norm[doc]))
                self.have[term, times] = (doc, adds.tolist(), int(adds.max()))
        return self.have[term, times]


class Best:
    """The highest (score, then lowest doc_id) of one item, in a heap with the worst in front."""

    def __init__(self, top: int):
        self.top, self.heap, self.tick = top, [], count()

    @property
    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        key = (score, doc_id is not None, -(doc_id or 0), next(self.tick), doc_id)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, key)
        elif key[:3] > self.heap[0][:3]:
            heapq.heapreplace(self.heap, key)


def rank_shard(lists: list[tuple[np.ndarray, list, int]], ids: list, best: Best) -> None:
    """Offers best what a shard's documents score over (documents, additions, largest addition) of each term."""
    lists = sorted(lists, key=lambda x: x[2])
    upto = np.cumsum([x[2] for x in lists]).tolist()
    if not lists or upto[-1] < best.least:
        return
    # Lists before head can't reach the least score together: they are looked up, from the one that adds most.
    head = bisect_left(upto, best.least)
    bits = len(lists).bit_length()
    mask = (1 << bits) - 1
    names = [(d << bits | j).tolist() if j >= head else None for j, (d, _, _) in enumerate(lists)]
    adds = [a for _, a, _ in lists]
    looked: dict[int, list] = {}
    at = [0] * len(lists)
    heap = [own[0] for own in names[head:]]
    heapq.heapify(heap)
    low, least = upto[head - 1] if head else 0, best.least
    while heap:
        top = heap[0]
        doc, score = top >> bits, 0
        while top >> bits == doc:
            j = top & mask
            k = at[j]
            score += adds[j][k]
            at[j] = k = k + 1
            own = names[j]
            if k < len(own):
                heapq.heapreplace(heap, own[k])
            else:
                heapq.heappop(heap)
                if not heap:
                    break
            top = heap[0]
        if score + low < least:
            continue
        for j in range(head - 1, -1, -1):
            if score + upto[j] < least:
                break
            if j not in looked:
                looked[j] = lists[j][0].tolist()
            docs = looked[j]
            k = bisect_left(docs, doc)
            if k < len(docs) and docs[k] == doc:
                score += adds[j][k]
        if score >= least:
            best.offer(score, ids[doc])
            least = best.least
            if head < len(lists) and upto[head] < least:
                # More lists can leave the heap.
                while head < len(lists) and upto[head] < least:
                    head += 1
                heap = [own[at[j]] for j, own in enumerate(names) if j >= head and at[j] < len(own)]
                heapq.heapify(heap)
                low = upto[head - 1]


def _search(items: list[tuple[int, list[tuple[int, int]]]], names: list[str], weights: list[int], n_docs: int, n_terms: int, top: int):
    """items: numbers, and of their terms (place in names, times)."""

    def run(batches):
        best, asked, weight = [Best(top) for _ in items], pa.array(names, pa.string()), np.array(weights, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Postings(batch, row, asked, weight, n_docs, n_terms)
                for kept, (_, terms) in zip(best, items):
                    rank_shard([own for term in terms if (own := shard.list(*term))], shard.ids, kept)
        rows = [(item, key[4], key[0]) for kept, (item, _) in zip(best, items) for key in kept.heap]
        yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64())})

    return run


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's top documents of an index, see rank_documents().

    Items are read to the driver in blocks of ITEMS_A_PASS or TERMS_A_PASS terms, each a pass over the shards.
    """
    spark = index.sparkSession
    share_code(spark)
    total = index.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    empty = spark.createDataFrame([], "item_id long, item long, doc_id long, score long")

    def passed(block):
        asked = sorted({t for _, _, terms in block for t in terms})
        if not n_docs or not asked:
            return []
        names = spark.createDataFrame([(t,) for t in asked], "term string")
        lists = index.select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).select("t.terms", "t.holders")
        df = lists.join(F.broadcast(names), F.col("terms") == F.col("term")).groupBy("term").agg(F.sum("holders").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
        held = df.select("term", weight.alias("w")).collect()
        place = {r.term: i for i, r in enumerate(held)}
        own = [(number, [(place[t], k) for t, k in terms.items() if t in place]) for number, _, terms in block]
        ids = spark.createDataFrame([(number, item) for number, item, _ in block], "item long, item_id long")
        # A task may run over several shards, and sends top rows an item at most.
        found = index.mapInArrow(_search(own, [r.term for r in held], [r.w for r in held], n_docs, n_terms, top), "item long, doc_id long, score long")
        return [found.join(F.broadcast(ids), "item").select("item_id", "item", "doc_id", "score")]

    found, block, size, number = [], [], 0, 0
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    for r in rows.toLocalIterator():
        terms = Counter(terms_of(r.t))
        block.append((number, r.i, terms))
        size, number = size + len(terms), number + 1
        if len(block) >= ITEMS_A_PASS or size >= TERMS_A_PASS:
            # Written before the next block comes, so that the driver holds one at a time.
            found += [stored(x) for x in passed(block)]
            block, size = [], 0
    found = [*found, *passed(block)]
    best = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    every = reduce(DataFrame.unionByName, found, empty)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def rank_documents(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the top documents with a score above 0, equal ones by ascending doc_id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as small letters, of whole texts. Null texts and
    texts without a term are no documents; an item without one, or whose terms no document holds, has no row. Rows that share a
    doc_id are documents each, those of null id too, which come last among equals; repeated rows of items count once, and
    items that share an id but not a text are ranked each. Empty tables give an empty one, other columns are not looked at.
    A document of any length is one task's, and one shard's.
    """
    return search(build_index(df, id_col, text_col, segment_bytes), items, item_col, item_text, top)
