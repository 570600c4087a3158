"""Product codes of vectors: integer codebooks learned in Spark rounds, nearest entries by a screened matrix product.

A part's nearest entry is that with the least |c|² - 2 x·c. A matrix product in float32 gives it for all entries at once, each
with an interval that rounding can't leave. An entry whose interval lies above the least upper end is out; where more than
one is left, those are evaluated again in int64, and of equals the lower index wins. So codes and errors are exact integers.

A round is one pass over the vectors: tasks send sums and counts for each entry, which Spark adds up; what the driver gets is a
codebook, whose size is fixed by parameters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share_code, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integers within it have squared distances, and sums over 2 ** 36 rows, that fit 64 bits.
LIMIT = 1 << 26
#: Rows that are screened at a time.
STRIP = 4096
_UNIT = 2.0**-24


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends (n, k) of |c|² - 2 x·c for integer rows x (n, d) and entries c (k, d).

    The product of two rounded vectors of d numbers, summed in any order, is off by (d + 2) units of |x| |c| at most, that of
    twice it no more, relatively; |c|² is exact before it is rounded once, and so is the difference. d + 6 units leave room.
    """
    square = np.einsum("ij,ij->i", c, c)
    value = (square.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ c.astype(np.float32).T)).astype(np.float64)
    size = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None] * np.sqrt(square.astype(np.float64))
    off = (c.shape[1] + 6) * _UNIT * 1.01 * (2 * size + square)
    return value - off, value + off


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer rows the index of the nearest entry, the lower of equals, and its exact squared distance."""
    low, high = intervals(x, c)
    left = low <= high.min(axis=1, keepdims=True)
    best = left.argmax(axis=1)
    several = np.flatnonzero(left.sum(axis=1) > 1)
    if several.size:
        row, entry = np.nonzero(left[several])
        gap = x[several[row]] - c[entry]
        far = np.einsum("ij,ij->i", gap, gap)
        # Pairs come by row, then by index; the stable sort leaves the lower of equals in front.
        order = np.lexsort((entry, far, row))
        first = order[np.searchsorted(row[order], np.arange(several.size))]
        best[several] = entry[first]
    gap = x - c[best]
    return best, np.einsum("ij,ij->i", gap, gap)


def _strips(batch, width: int):
    """The batch's vectors as integers, at most STRIP rows at a time."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for at in range(0, len(flat), STRIP):
        yield flat[at : at + STRIP].astype(np.int64)


def _sums(books: np.ndarray):
    parts, entries, d = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in batches:
            for x in _strips(batch, parts * d):
                for p in range(parts):
                    own = x[:, p * d : (p + 1) * d]
                    code, _ = nearest(own, books[p])
                    count[p] += np.bincount(code, minlength=entries)
                    np.add.at(total[p], code, own)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry]), "sums": pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))}
        )

    return run


def _coded(books: np.ndarray):
    parts, _, d = books.shape

    def run(batches):
        for batch in batches:
            codes, errors = [], [np.zeros(0, np.int64)]
            for x in _strips(batch, parts * d):
                both = [nearest(x[:, p * d : (p + 1) * d], books[p]) for p in range(parts)]
                codes += [bytes(row).hex() for row in np.stack([b for b, _ in both], axis=1).astype(np.uint8)]
                errors.append(sum(e for _, e in both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], names=["vec_id", "label", "code", "error"]
            )

    return run


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, label, v: the rows whose vector has no null and no number that isn't finite, as integers floor(SCALE * x); v is null
    where one of them lies beyond LIMIT."""
    x = F.col(vector_col).cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).where("x is not null").where(~F.exists("x", odd))
    small = F.forall("x", lambda c: F.abs(c) < LIMIT / SCALE)
    return rows.select("vec_id", "label", F.when(small, F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))).alias("v"))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width): the parts of the entries vectors of smallest vec_id; of rows that share one, by their numbers. Null
    ids come last. All have the length of the first; fewer rows make fewer entries."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    usable = vectors.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    lead = usable.orderBy(order).limit(1).select(F.size("v")).first()
    if lead is None:
        return np.zeros((parts, 0, 1), np.int64)
    rows = usable.where(F.size("v") == lead[0]).orderBy(order).limit(entries).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def learned_codebooks(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds: all parts go to their nearest entry, which becomes the floor of their mean; one that
    none goes to stays."""
    for _ in range(rounds):
        sums = vectors.mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        n, d = F.sum("n").alias("n"), books.shape[2]
        new = books.copy()
        # parts * entries rows at most.
        for r in sums.groupBy("part", "entry").agg(n, F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums")).collect():
            new[r.part, r.entry] = [s // r.n for s in r.sums]
        books = new
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' numbers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector is whole (see whole_vectors()).

    code has two hex digits for each part; error is the squared distance of the whole integer vector from what its code stands
    for; label_error its sum over the rows of a label, those without one together. Null and repeated ids keep their rows.
    Vectors of another length than the first by id, of one that parts don't divide, or with a number beyond LIMIT / SCALE keep
    their row too, with a null code and error, and teach nothing. An empty table gives an empty one, and other columns are not
    looked at, whatever their names. Vectors are written once as integers, and each round and the coding read them once.
    """
    spark = df.sparkSession
    share_code(spark)
    vectors = stored(whole_vectors(df, id_col, vector_col, label_col))
    books = first_codebooks(vectors, parts, entries)
    fits = F.coalesce(F.size("v") == books.shape[0] * books.shape[2], F.lit(False)) if books.shape[1] else F.lit(False)
    taught = vectors.where(fits)
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if books.shape[1]:
        books = learned_codebooks(taught.select("v"), books, rounds)
        coded = taught.mapInArrow(_coded(books), schema)
    else:
        coded = spark.createDataFrame([], schema)
    rest = vectors.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = stored(coded.unionByName(rest))
    # A row for each label; where these are few Spark broadcasts them, else a label that very many rows have is split.
    sums = rows.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("_of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
