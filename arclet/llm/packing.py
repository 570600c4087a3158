"""Best-fit packing of token sequences, partition by partition and then up a tree.

Each partition packs its own pieces best-fit, longest first. Bins that are nearly full leave for good; underfull ones go on as
items, whole, to a quarter of the partitions, where they are packed again. Best fit leaves a partition at most one bin
that is no more than half full, so where FAN_IN partitions meet only FAN_IN bins look for room, and no more bins than that
can give it to them: a partition sends its FAN_IN + 1 emptiest bins, and all others leave too, as no further round could
fill them. So the last partition sees some twenty bins, however many there are.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from . import common
from .common import share_code, stored, text_frame

CAPACITY = 4096
END_ID = 1
#: A bin with at most this share of its places free is left as it is.
FREE_SHARE = 1 / 64
#: Partitions whose underfull bins meet in one.
FAN_IN = 4
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 280_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "used long, items array<struct<doc_id: long, piece: int, length: long, row: long>>, full boolean"


#: Words of Latin-1 letters, which go straight to the model once they are small, and marks that may follow: all of ASCII but the apostrophe.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
PLAIN = rf"\A(?P<letters>[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)(?P<marks>[{re.escape(MARKS)}]*)\z"


class WordIds:
    """Ids of texts by one tokenizer, as little-endian 32-bit words; ids of runs of letters are remembered.

    For tokenizers that make all letters small, drop white space and never look across it, nor from letters to marks: a
    text's ids are those of its words in turn. Of a plain word the letters go straight to the tokenizer's model; any other
    word passes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Ids of odd words; ids of runs of letters and of runs of marks, and those of an older generation.
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    @classmethod
    @cache
    def of_worker(cls, path: str) -> "WordIds":
        """One for all tasks of a Python worker."""
        return cls(path)

    @staticmethod
    def words(text: str) -> list[str]:
        return re.split("[ \t\n\r]", text)

    def _encode(self, tokenizer: Tokenizer, words: list[str], known: dict[str, bytes]) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            known.update(zip(part, [_packed(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]))

    def learn(self, texts: list[list[str]]) -> None:
        """Takes up the words of texts."""
        self.of_texts([" ".join(words) for words in texts])

    def of(self, words: list[str]) -> bytes:
        return self.of_texts([" ".join(words)])[0]

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids. Arrow splits texts at ASCII white space, so that only distinct runs of letters and odd words come here;
        an odd word may hold other white space, as the tokenizer drops that."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        if len(self.parts) > CACHE_WORDS:
            self.parts, self.older = {"": b""}, self.parts
        known, parts, older = self.known, self.parts, self.older
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        both = pc.extract_regex(coded.dictionary, PLAIN)
        odd = coded.dictionary.filter(pc.is_null(both)).to_numpy(zero_copy_only=False).tolist()
        letters, marks = (x.dictionary_encode() for x in (pc.utf8_lower(pc.struct_field(both, [0])), pc.struct_field(both, [1])))
        some, ends = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (letters, marks))
        new = [x for x in some if x not in parts]
        parts.update((x, older[x]) for x in new if x in older)
        self._encode(self.model, [x for x in new if x not in older], parts)
        self._encode(self.tokenizer, [x for x in ends if x not in parts], parts)
        self._encode(self.tokenizer, [x for x in odd if x not in known], known)
        found = [parts[x] for x in some] + [parts[x] for x in ends] + [known[x] for x in odd] + [b""]
        # A word is two of these: its letters and marks, or itself and nothing.
        two = np.full((len(coded.dictionary), 2), len(found) - 1)
        plain = pc.is_valid(both).to_numpy(zero_copy_only=False)
        two[plain, 0] = letters.indices.drop_null().to_numpy()
        two[plain, 1] = marks.indices.drop_null().to_numpy() + len(some)
        two[~plain, 0] = len(some) + len(ends) + np.arange(len(odd))
        every = two[coded.indices.to_numpy()].ravel()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n, first = sizes[every], (np.cumsum(sizes) - sizes)[every]
        stops = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(found), np.uint32)[np.arange(stops[-1]) + np.repeat(first - stops[:-1], n)]
        bounds = stops[2 * split.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def _packed(ids) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = WordIds.of_worker(path), _packed([end_id])
        # By the module: this function travels with copies of what it names.
        if WordIds.of_worker.cache_clear not in common.HELD:
            common.HELD.append(WordIds.of_worker.cache_clear)
        for pdf in batches:
            texts, rows, part, size = ["" if t is None else t for t in pdf["text"]], [], [], 0
            for i, (doc, text) in enumerate(zip(pdf["doc_id"], texts)):
                part.append((doc, text))
                size += len(text)
                if size < 2 << 20 and i < len(texts) - 1:
                    continue
                for (d, _), own in zip(part, words.of_texts([t for _, t in part])):
                    ids = own + end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        rows.append((d, k, a // 4, len(own) // 4, zlib.crc32(own)))
                part, size = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most capacity ids: doc_id, piece, start, length, ids_crc32. A null text has the end id alone, as an
    empty one; rows that share an id, or have none, are cut each for itself; an empty table has no piece. A text of any
    length is one task's: it is held as words and ids.

    tokenizer_path: a file that driver and executors see; it must drop white space between words (see WordIds).
    """
    share_code(df.sparkSession)
    return text_frame(df, id_col, text_col).mapInPandas(_cut(tokenizer_path, capacity, end_id), PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of items by bin; items go, longest first, to the fullest bin that has room. A bit marks each free size in use."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = open_sizes >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_sizes ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - size
        by_free[left].append(b)
        open_sizes |= 1 << left
    return bins


def _pack(capacity: int, least: float, onward: int):
    """onward: the emptiest bins go on, if they are under least; all others are full."""

    def run(batches):
        items: list[list] = []
        sizes: list[int] = []
        for pdf in batches:
            items += pdf["items"].tolist()
            sizes += pdf["used"].tolist()
        bins = sorted(((sum(sizes[i] for i in own), own) for own in best_fit(sizes, capacity)), key=lambda b: b[0])
        out = []
        for k, (used, own) in enumerate(bins):
            out.append((used, [dict(x) for i in own for x in items[i]], used >= least or k >= onward))
            if len(out) == 2000:
                yield pd.DataFrame(out, columns=["used", "items", "full"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["used", "items", "full"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """pieces (doc_id, piece, length <= capacity, ...) with sequence_id and offset added.

    Bins of one round are written to the shared folder before the next, so a lost executor repeats part of a round. Pieces
    are dealt by a hash of id and number, never by chance. A partition holds the sizes and ids of its pieces, and partitions
    grow in number with the pieces: about 50,000 each by default. Every row is a piece of its own, by a key it gets here, whatever
    its doc_id; sequence_id is the key of the bin's first piece. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    share_code(spark)
    # Written once with its rows' keys, which everything below reads.
    keyed = stored(pieces.withColumn("_row", F.monotonically_increasing_id()))
    columns, pieces = pieces.columns, keyed
    n = partitions or -(-pieces.count() // 50_000) or 1
    one = F.array(F.struct("doc_id", "piece", "length", F.col("_row").alias("row")))
    whole = pieces.where(F.col("length") == capacity).select(F.col("length").alias("used"), one.alias("items"))
    open_items = pieces.where(F.col("length") < capacity).select(F.col("length").alias("used"), one.alias("items"))
    done = [whole]
    while True:
        last = n == 1
        head = F.col("items")[0]
        # Pieces of null id are many to one key, so their rows' keys deal them.
        dealt = open_items.repartition(n, F.xxhash64(head["doc_id"], head["piece"], F.when(head["doc_id"].isNull(), head["row"])))
        packed = stored(dealt.sortWithinPartitions(F.desc("used"), head["doc_id"], head["piece"], head["row"]).mapInPandas(_pack(capacity, capacity * (1 - FREE_SHARE), 0 if last else FAN_IN + 1), BINS))
        done.append(packed.where("full").select("used", "items"))
        if last:
            break
        open_items, n = packed.where("not full").select("used", "items"), -(-n // FAN_IN)
    bins = done[0]
    for x in done[1:]:
        bins = bins.unionByName(x)
    bins = bins.withColumn("sequence_id", F.col("items")[0]["row"])
    ends = F.transform("items", lambda x, i: F.aggregate(F.slice("items", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"]))
    placed = bins.withColumn("offsets", ends).select("sequence_id", F.explode_outer(F.arrays_zip("items", "offsets")).alias("x"))
    placed = placed.select(F.col("x.items.row").alias("_row"), "sequence_id", F.col("x.offsets").alias("offset"))
    return pieces.join(placed, "_row").select(*columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenizes, cuts and packs documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Other columns of df are
    not looked at; see token_pieces() and pack() for nulls, repeated rows, ties and empty tables."""
    return pack(token_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id), capacity)
