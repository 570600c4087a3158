"""Storage, words and shingles shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import session
from ..plans.session import file_system

#: Bytes of rows that go to a Python worker at a time, so that its memory doesn't depend on how long texts are.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What separates words, as a Java expression and as bytes.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
GAP_BYTES = np.zeros(256, bool)
GAP_BYTES[[9, 10, 11, 12, 13, 32]] = True
#: The same for words without marks: every ASCII byte that is no letter or digit.
MARK_BYTES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Text bytes hashed at a time.
PIECE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package, and sends them rows in batches of BATCH_BYTES or less. A row that is larger is a
    batch of its own."""
    session.share_code(spark)
    if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors all see, below spark.checkpoint.dir. Where that is unset it is a temporary folder if
    all is one machine, as in tests, else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/checkpoints/arclet"
    path = f"{top.rstrip('/')}/arclet-{uuid.uuid4().hex}"
    _FOLDERS.get().append(path)
    return path


#: The folders that were written and not dropped: of the process, or of the run of own_folders() that a thread is in.
_FOLDERS: ContextVar[list[str]] = ContextVar("folders", default=[])  # noqa: B039


@contextmanager
def own_folders():
    """Folders written inside are a list of their own, so that runs side by side drop none of each other's; those that are left in the
    end go to the list outside."""
    outside = _FOLDERS.get()
    token = _FOLDERS.set([])
    try:
        yield
    finally:
        outside += _FOLDERS.get()
        _FOLDERS.reset(token)


def drop_stored(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the folders that were written (see own_folders()), but for the first since (see mark()) and the last keep of them.
    Frames made of them can't be read afterwards."""
    own = _FOLDERS.get()
    for folder in own[since : len(own) - keep]:
        files, path = file_system(spark, folder)
        files.delete(path, True)
        own.remove(folder)


def mark() -> int:
    """For drop_stored(): how many folders there are now."""
    return len(_FOLDERS.get())


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends, and a lost executor costs no more than one stage."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body of value, computed once a row: an inner lambda would otherwise compute a projected value again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finaliser of the public MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), or more; those for pieces of the usual size are kept."""
    have = _POWERS.get(int(base))
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.full(max(n, 5 * PIECE_BYTES // 4), base)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if len(out) <= 2 * PIECE_BYTES:
        _POWERS[int(base)] = out
    return out[:n]


#: Small letters for those of Latin-1.
_SMALL = bytes(b + 32 if 65 <= b <= 90 or 192 <= b <= 222 and b != 215 else b for b in range(256))


def small_bytes(text: str) -> bytes:
    """text.lower() in UTF-8."""
    try:
        return text.encode("latin-1").translate(_SMALL).decode("latin-1").encode()
    except UnicodeEncodeError:
        return text.lower().encode("utf-8", "surrogatepass")


class Words:
    """The words of many texts as spans of one byte array, and hashes of runs of them.

    A run's hash is that of its words with one space between, whatever white space the texts have. Hashes come from
    prefix sums of a polynomial over the bytes, so that a run of any length costs the same.
    """

    def __init__(self, raw: np.ndarray, ends: np.ndarray, gaps: np.ndarray = GAP_BYTES):
        """raw: bytes of texts, each followed by a space; ends: where each text's space lies, plus 1."""
        gap = gaps[raw]
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        if keep.size:
            keep[0] = not gap[0]
        upto = np.cumsum(keep, dtype=np.int64)[ends - 1] if ends.size else ends
        data = np.where(gap, np.uint8(32), raw)[keep]
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        #: Where each word ends, in bytes of the texts with one space between words.
        self.stop = np.flatnonzero(data == 32)
        first = np.concatenate(([0], self.stop[:-1] + 1)).astype(np.int64) if self.stop.size else self.stop
        # Prefix sums of (byte + 1) * base ** place, and base ** -place at the words' starts.
        sums = np.zeros(data.size + 1, np.uint64)
        np.add(data, 1, out=sums[1:], casting="unsafe", dtype=np.uint64)
        sums[1:] *= powers(_BASE, data.size)
        np.cumsum(sums, out=sums)
        self.low, self.high = sums[first], sums[self.stop]
        self.back = powers(_INVERSE, data.size)[first]
        self._sums, self._first = sums, first
        #: Of each text, the words before and up to it.
        self.word_ends = np.searchsorted(self.stop, upto, side="left")
        self.word_starts = np.concatenate(([0], self.word_ends[:-1])).astype(np.int64) if ends.size else self.word_ends

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs from word first to word last, both included."""
        return mixed((self.high[last] - self.low[first]) * self.back[first])

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of every word, other than those of words."""
        return mixed((self._sums[np.minimum(self._first + n, self.stop)] - self.low) * self.back ^ np.uint64(n))

    @property
    def count(self) -> int:
        return self.stop.size

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all runs of so many words, one from each word that has as many after it, whichever text they are of."""
        first = np.arange(max(0, self.count - width + 1))
        return self.hashes(first, first + width - 1) if first.size else np.zeros(0, np.uint64)


class LongText:
    """As Words, of one text too long to be held in arrays of its bytes: it is taken in pieces, each with the last words of the
    one before. What is held is the text and the hashes asked for. A single word is one piece, whatever its length."""

    def __init__(self, raw: bytes, gaps: np.ndarray):
        self.raw, self.gaps = raw, gaps
        self.count = sum(w.stop.size for w in self._pieces(1))
        self.word_starts, self.word_ends = np.array([0]), np.array([self.count])

    def _pieces(self, width: int):
        at, kept, raw, gaps = 0, b"", self.raw, self.gaps
        while at < len(raw):
            end = at + PIECE_BYTES
            while end < len(raw) and not (hit := np.flatnonzero(gaps[np.frombuffer(raw, np.uint8, min(PIECE_BYTES, len(raw) - end), end)])).size:
                end += PIECE_BYTES
            end = end + int(hit[0]) + 1 if end < len(raw) else len(raw)
            part = np.frombuffer(kept + raw[at:end] + b" ", np.uint8)
            words = Words(part, np.array([len(part)]), gaps)
            yield words
            if width > 1:
                # The last width - 1 words go before the next piece.
                inside = np.flatnonzero(np.diff(np.concatenate(([1], gaps[part].astype(np.int8)))) == -1)
                kept = part[inside[-(width - 1) :][0] :].tobytes() if inside.size else b""
            at = end

    def runs(self, width: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(w.runs(width) for w in self._pieces(width))])

    def beginnings(self, n: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(w.beginnings(n) for w in self._pieces(1))])


#: What frees things that a Python worker keeps from task to task for one operator.
HELD: list = []


def pieces(texts, plain: bool = False):
    """Texts in pieces of bounded size: (start, stop, words) with numbers of texts. Null texts have no word.

    Words are parted by white space, and A-Z are lower case; plain: parted by any ASCII mark, and all letters lower case.
    What the worker still keeps for another operator goes.
    """
    while HELD:
        HELD.pop()()
    start, size, part, gaps = 0, 0, [], MARK_BYTES if plain else GAP_BYTES

    def joined():
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        return start, start + len(part), Words(raw, np.cumsum([len(x) + 1 for x in part]), gaps)

    for i, t in enumerate(texts):
        coded = b"" if t is None else small_bytes(t) if plain else t.encode("utf-8", "surrogatepass")
        if len(coded) > 2 * PIECE_BYTES:
            if part:
                yield joined()
            yield i, i + 1, LongText(coded, gaps)
            start, size, part = i + 1, 0, []
            continue
        part.append(coded)
        size += len(coded) + 1
        if size >= PIECE_BYTES:
            yield joined()
            start, size, part = i + 1, 0, []
    if part:
        yield joined()


def shingle_sets(texts, k: int = 5):
    """Of each text its distinct shingles of k words, as sorted hashes; with fewer words, all of them as one."""
    for _, _, words in pieces(texts):
        hashes = words.runs(k)
        for a, b in zip(words.word_starts, words.word_ends):
            if b - a >= k:
                yield np.unique(hashes[a : b - k + 1])
            elif b > a:
                yield words.hashes(np.array([a]), np.array([b - 1])) if isinstance(words, Words) else words.runs(b - a)
            else:
                yield np.zeros(0, np.uint64)


def text_frame(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under its own names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
