"""Benchmark passages in documents, by SimHash of item-sized windows and multi-index Hamming blocks.

Every item has a 64-bit SimHash of its word shingles, weighted by how often each occurs. A document has one such
fingerprint for every window of as many shingles as some item. The index has a table for each of four 16-bit blocks: by a
block's value, the items whose own block differs from it by at most a quarter of the radius. Whatever lies within the
radius of an item does so in one block at least, so the four tables name every item within the radius of a window, and
few others. Candidates count if the weighted Jaccard similarity of the shingles themselves reaches the threshold.

Fingerprints of windows are not summed bit by bit: bit planes of counters hold 64 counts in a few machine words, and the
window of m + 1 shingles is that of m with one addition. For items longer than PLANE_WINDOW, sums over each bit serve.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, share_code, stored, text_frame

SHINGLE = 5
SIMILARITY = 0.75
#: Of windows at similarity 0.75 to 0.85 simulated fingerprints leave none beyond it; 15 lost 4.6 % at 0.75 to 0.77.
RADIUS = 23
#: Windows of up to so many shingles grow by additions; longer ones are found one size at a time.
PLANE_WINDOW = 128
#: Items that are looked for in one pass over the documents; more take more passes.
ITEMS_A_PASS = 2048
#: Items that one index holds: a bit each in its tables.
ITEMS_AN_INDEX = 64
#: Places in the table of shingles that items have.
SEEN = 1 << 22
#: Windows worked on at a time, so that their planes stay in the processor's cache.
STRIP = 16384


def simhash(h: np.ndarray) -> np.uint64:
    """Of shingle hashes, repeated ones weighing more: each bit that more than half of them have."""
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    on = bits.sum(axis=0) * 2 > len(h)
    return np.bitwise_or.reduce(np.where(on, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)))


class BlockIndex:
    """Of each of four blocks, by its 65,536 values, which of at most ITEMS_AN_INDEX fingerprints have a block near it, as bits."""

    def __init__(self, prints: np.ndarray, errors: int):
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(prints) <= 8 * np.dtype(k).itemsize)
        every = np.arange(1 << 16, dtype=np.uint16)
        self.prints, self.tables = prints, np.zeros((4, 1 << 16), kind)
        for j, blocks in enumerate(prints.view(np.uint16).reshape(-1, 4)):
            for b in range(4):
                self.tables[b] |= (np.bitwise_count(every ^ blocks[b]) <= errors).astype(kind) << kind(j)

    def named(self, found: np.ndarray) -> np.ndarray:
        """Of fingerprints, the items that their blocks name, as bits."""
        blocks = found.view(np.uint16).reshape(-1, 4)
        bits = self.tables[0].take(blocks[:, 0], mode="clip")
        for b in (1, 2, 3):
            bits |= self.tables[b].take(blocks[:, b], mode="clip")
        return bits

    def pairs(self, found: np.ndarray, bits: np.ndarray, radius: int):
        """(places, items) of the named pairs that lie within the radius."""
        w, q = [], []
        for j in range(len(self.prints)):
            at = np.flatnonzero(bits >> bits.dtype.type(j) & bits.dtype.type(1))
            at = at[np.bitwise_count(found[at] ^ self.prints[j]) <= radius]
            w.append(at)
            q.append(np.full(len(at), j))
        return np.concatenate(w), np.concatenate(q)


class Group:
    """The items of one width and number of shingles."""

    def __init__(self, size: int, own: list[tuple[int, np.ndarray]], errors: int):
        self.size, self.items, self.errors = size, [i for i, _ in own], errors
        self.counts = [Counter(h.tolist()) for _, h in own]
        self.prints = np.array([simhash(h) for _, h in own], np.uint64)

    @cached_property
    def indexes(self) -> list[BlockIndex]:
        """Made in the worker that looks things up, not sent to it."""
        return [BlockIndex(self.prints[a : a + ITEMS_AN_INDEX], self.errors) for a in range(0, len(self.prints), ITEMS_AN_INDEX)]

    def near(self, found: np.ndarray, radius: int):
        """(places, item numbers) of fingerprints within the radius."""
        for k, index in enumerate(self.indexes):
            bits = index.named(found)
            at = np.flatnonzero(bits)
            if at.size:
                w, q = index.pairs(found[at], bits[at], radius)
                if w.size:
                    yield at[w], q + k * ITEMS_AN_INDEX

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "indexes"}


class Probes:
    """Items by width and number of shingles."""

    def __init__(self, items: list[tuple[int, str]], k: int = SHINGLE, radius: int = RADIUS):
        self.k, self.radius = k, radius
        found: dict[tuple[int, int], list] = defaultdict(list)
        for item, text in items:
            for _, _, words in pieces([text], plain=True):
                width = min(k, words.count)
                if width:
                    h = words.runs(width)
                    found[width, len(h)].append((item, h))
        #: By a hash's low bits, whether an item may have it.
        self.seen = np.zeros(SEEN, bool)
        for own in found.values():
            for _, h in own:
                self.seen[h & np.uint64(SEEN - 1)] = True
        self.by = {size: Group(size[1], own, radius // 4) for size, own in sorted(found.items())}

    def shared(self, h: np.ndarray) -> np.ndarray:
        """Of hashes, how many before each place (and in all) an item may have: never too few."""
        out = np.zeros(len(h) + 1, np.int32)
        np.cumsum(self.seen[h & np.uint64(SEEN - 1)], out=out[1:])
        return out

    def candidates(self, h: np.ndarray, width: int, shared: np.ndarray | None = None, least: float = 0.0):
        """(size, places of windows, item numbers) within the radius, for hashes of shingles of that width.

        With counts of shared shingles, windows where these are under that share are left out.
        """
        sizes = [m for w, m in self.by if w == width]

        def found(m, at, prints):
            keep = np.arange(len(prints))
            if shared is not None:
                # Before the index is asked, as hardly a window shares enough.
                keep = np.flatnonzero(shared[at + m : at + m + len(prints)] - shared[at : at + len(prints)] >= math.ceil(least * m))
            if keep.size:
                for places, items in self.by[width, m].near(prints[keep], self.radius):
                    yield m, at + keep[places], items

        for at in range(0, len(h), STRIP) if sizes else ():
            for m, over in _windows(h[at : at + STRIP + PLANE_WINDOW - 1], [m for m in sizes if m <= PLANE_WINDOW]):
                yield from found(m, at, over)
        for m in sizes:
            if m > PLANE_WINDOW:
                for at in range(0, len(h) - m + 1, STRIP):
                    if shared is None or (shared[at + m : at + m + STRIP] - shared[at : len(shared) - m][:STRIP] >= least * m).any():
                        yield from found(m, at, _long_windows(h[at : at + STRIP + m - 1], m))

    def shorter(self, h: np.ndarray, width: int, words, shared: np.ndarray, similarity: float):
        """(number of text, (item, similarity, 0, words)) of texts with fewer shingles than an item, each compared whole."""
        sizes = [m for w, m in self.by if w == width]
        n = words.word_ends - words.word_starts - width + 1
        few = np.flatnonzero((n > 0) & (n < sizes[-1]))
        first = words.word_starts[few]
        for d in few[shared[first + n[few]] - shared[first] >= similarity * n[few]]:
            own = int(n[d])
            mine = Counter(h[words.word_starts[d] :][:own].tolist())
            for m in sizes:
                if own < m and similarity * m <= own:
                    group = self.by[width, m]
                    for item, there in zip(group.items, group.counts):
                        low = sum((mine & there).values())
                        if low and low >= similarity * (m + own - low):
                            yield d, (item, low / (m + own - low), 0, own + width - 1)


def _windows(h: np.ndarray, sizes: list[int]):
    """(m, fingerprints) of all windows of each size that start in the first STRIP places; sizes ascend."""
    store = np.empty((9, STRIP), np.uint64)
    spare = np.empty((3, STRIP), np.uint64)
    n, used = min(STRIP, len(h)), 0
    for m in range(1, min(sizes[-1], len(h)) + 1) if sizes else ():
        n = min(n, len(h) - m + 1)
        # One more shingle in every window: its bits ripple through the planes, in place.
        carry = h[m - 1 : m - 1 + n]
        for j in range(used):
            plane, rest = store[j, :n], spare[j & 1, :n]
            np.bitwise_and(plane, carry, out=rest)
            np.bitwise_xor(plane, carry, out=plane)
            carry = rest
        if m & (m - 1) == 0:
            store[used, :n] = carry
            used += 1
        if m not in sizes:
            continue
        # count >= m // 2 + 1, as the carry out of count + 2 ** used - that.
        add, over = (1 << used) - (m // 2 + 1), spare[2, :n]
        low = (add & -add).bit_length() - 1
        over[:] = store[low, :n]
        for j in range(low + 1, used):
            (np.bitwise_or if add >> j & 1 else np.bitwise_and)(over, store[j, :n], out=over)
        yield m, over


def _long_windows(h: np.ndarray, m: int) -> np.ndarray:
    """Fingerprints of all windows of m shingles, bit by bit by running sums."""
    out = np.zeros(len(h) - m + 1, np.uint64)
    sums = np.zeros(len(h) + 1, np.int64)
    for bit in np.arange(64, dtype=np.uint64):
        np.cumsum(h >> bit & np.uint64(1), out=sums[1:])
        out |= (2 * (sums[m:] - sums[:-m]) > m).astype(np.uint64) << bit
    return out


def _search(probes: Probes, similarity: float):
    widths = sorted({w for w, _ in probes.by})

    def run(batches):
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            rows = []
            for start, stop, words in pieces(pdf["text"], plain=True):
                for width in widths:
                    h = words.runs(width)
                    shared = probes.shared(h)
                    # At similarity s at least 2s / (1 + s) of the shingles are shared; s is a bound that rounding can't reach.
                    for m, places, which in probes.candidates(h, width, shared, similarity):
                        group = probes.by[width, m]
                        doc = np.searchsorted(words.word_ends, places, side="right")
                        inside = places + m + width - 1 <= words.word_ends[np.minimum(doc, len(words.word_ends) - 1)]
                        for p, q, d in zip(places[inside], which[inside], doc[inside]):
                            window, there = h[p : p + m].tolist(), group.counts[q]
                            # A cheap bound before the exact count: at similarity s at least 2s / (1 + s) of the shingles are shared.
                            if sum(map(there.__contains__, window)) < similarity * m:
                                continue
                            mine = Counter(window)
                            low = sum((mine & there).values())
                            if low >= similarity * (2 * m - low):
                                rows.append((ids[start + d], group.items[q], low / (2 * m - low), p - words.word_starts[d], m + width - 1))
                    rows += [(ids[start + d], *row) for d, row in probes.shorter(h, width, words, shared, similarity)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "start_word", "n_words"])
            if len(out):
                out = out.sort_values(["doc_id", "item_id", "similarity", "start_word"], ascending=[True, True, False, True])
                yield out.drop_duplicates(["doc_id", "item_id"])

    return run


def find_leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start_word, n_words): the best window of each document for each item that leaks, the
    first of equally similar ones.

    Words are lower case and parted by ASCII marks and white space; shingles have five words, or all of a shorter item.
    Similarity is weighted Jaccard, of shingles with their counts. A document with fewer shingles than an item is
    one window, whole. Null texts, ids of items and blank items find nothing, and empty tables give an empty one; rows that
    share a doc_id are one document here, those of null id too, whose row has a null id. Other columns are not looked at.
    Items are read to the driver in blocks of ITEMS_A_PASS, each block taking one pass over df; documents are not shuffled.
    A document of any length is one task's, and costs its length for each size of item.
    """
    share_code(df.sparkSession)
    docs = text_frame(df, id_col, text_col).where("text is not null")
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    rows = items.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).dropna().distinct()

    def passed(block):
        probes = Probes(block, radius=radius)
        return [docs.mapInPandas(_search(probes, similarity), schema)] if probes.by else []

    found, block = [], []
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS_A_PASS:
            # Written before the next block comes, so that the driver holds one at a time.
            found += [stored(x) for x in passed(block)]
            block = []
    found = [*found, *passed(block)] or [df.sparkSession.createDataFrame([], schema)]
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "start_word", "n_words")).alias("b")
    every = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best)
    return every.select("doc_id", "item_id", (-F.col("b.far")).alias("similarity"), "b.start_word", "b.n_words")


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df without the rows whose document holds a passage of items; rows of null id stay, and all columns of df. Rows that
    share an id go together. See find_leaks()."""
    # A table of its own: its size is known, and while it is small texts need no shuffle.
    leaks = stored(find_leaks(df, items, id_col, text_col, **how).select(F.col("doc_id").alias(id_col)).distinct())
    return df.join(leaks, id_col, "left_anti")
