"""Language of texts by error-correcting output codes over byte n-grams.

Every language has a codeword. One linear classifier per bit, on counts of byte 2- and 3-grams of the whole text, says
which half of the languages a text belongs to; the codeword whose bits cost least, each bit's loss weighted by how well
its classifier does on rows left out, is the language. A near tie between two codewords is flagged.

The classifiers are ridge regressions on -1 and 1, all solved at once in the space of the learning rows, where leaving
out a row has a closed form.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import share_code, stored, text_frame

#: Learning rows at most, a documented bound: of each language those whose hashed ids are smallest.
TRAIN_ROWS_A_LANGUAGE = 500
#: The same for all languages together. Every language has a row at least, so that this bounds their number too.
TRAIN_ROWS = 4000
#: Buckets that n-grams are hashed to; those that share one count together.
BUCKETS = 1 << 12
RIDGE = 0.05
#: Log odds of a regression value of 1.
SHARPNESS = 6.0
#: Two languages whose shares are closer than this make a text ambiguous.
AMBIGUOUS = 0.2
#: Bytes whose n-grams are counted at a time.
STRIP = 1 << 20
UNKNOWN = "und"


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the byte 2- and 3-grams of the text in lower case, by bucket."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(b) - 1, STRIP):
        x = b[at : at + STRIP + 2].astype(np.uint32)
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] + x[2:] * np.uint32(0xC2B2AE3D)
        for h in (two[: STRIP], three[: STRIP]):
            h = h ^ (h >> np.uint32(15))
            h = h * np.uint32(0x27D4EB2F)
            total += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    return total


def features(text: str) -> np.ndarray:
    """Square roots of the counts' shares: a vector of length one."""
    c = ngram_counts(text)
    return np.sqrt(c / max(1, c.sum()))


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of k languages as rows of -1 and 1: all splits of up to five languages, else random ones far apart."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        splits = np.arange(1, 1 << (k - 1))
        return np.array([np.ones(len(splits)), *[1 - 2.0 * (splits >> i & 1) for i in range(k - 1)]])
    rng, best, far = np.random.default_rng(seed), None, -1.0
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, n))
        if (np.abs(m.sum(axis=0)) == k).any():
            continue
        least = ((n - m @ m.T) / 2 + np.eye(k) * n).min()
        if least > far:
            best, far = m, least
    return best


@dataclass
class Codes:
    langs: list[str]
    matrix: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, shares and margins of rows of features: the codeword with the least weighted log loss."""
        if not self.langs:
            return [UNKNOWN] * len(x), np.zeros(len(x)), np.zeros(len(x))
        odds = x @ self.weights.T + self.bias
        loss = np.stack([(np.logaddexp(0, -m * odds) * self.trust).sum(axis=1) for m in self.matrix], axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        margin = order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)
        return [self.langs[i] for i in share.argmax(axis=1)], share.max(axis=1), margin


def _features_of(batches):
    for pdf in batches:
        rows = []
        for d, lang, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
            c = ngram_counts(t)
            at = np.flatnonzero(c)
            rows.append((d, lang, at.astype(np.int32), np.sqrt(c[at] / max(1, c.sum())).astype(np.float32)))
        yield pd.DataFrame(rows, columns=["doc_id", "lang", "col", "val"])


def fit_codes(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows_a_language: int = TRAIN_ROWS_A_LANGUAGE) -> Codes:
    """Learns from rows with text and language: at most rows_a_language of each, taken by hashed id.

    Documented bounds: rows_a_language, and TRAIN_ROWS in all, which all languages that have a text with a letter share: of
    those with many rows as many go as it takes, and a language keeps one at least. Beyond TRAIN_ROWS languages the first by
    name are learned. Rows of one id and language are drawn together; rows of null id come last. Without rows every text is
    "und". Two passes: one finds which rows are drawn, of which it moves numbers only, one takes their texts.
    """
    share_code(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(r"lang is not null and text is not null and text rlike '\\p{L}'").withColumn("mark", F.xxhash64("text"))
    # Each task sends rows_a_language rows of a language at most.
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.col("doc_id").isNull(), F.xxhash64("doc_id"), "doc_id", "mark"))
    drawn = rows.select("doc_id", "lang", "mark").withColumn("nth", nth).where(F.col("nth") <= rows_a_language)
    # So many of each language that all have TRAIN_ROWS at most: bounded numbers, one for each place in a language's order.
    drawn = stored(drawn)
    upto, quota = 0, 0
    for r in drawn.groupBy("nth").count().orderBy("nth").collect():
        upto += r["count"]
        quota = r["nth"] if upto <= TRAIN_ROWS or r["nth"] == 1 else quota
    drawn = drawn.where(F.col("nth") <= quota).orderBy("nth", "lang").limit(TRAIN_ROWS).drop("nth").distinct()
    sample = rows.join(F.broadcast(drawn.withColumnRenamed("doc_id", "id")), F.col("doc_id").eqNullSafe(F.col("id")) & (rows["lang"] == drawn["lang"]) & (rows["mark"] == drawn["mark"]))
    sample = sample.select("doc_id", rows["lang"], "text").dropDuplicates(["doc_id", "lang", "text"])
    data = sample.mapInPandas(_features_of, "doc_id long, lang string, col array<int>, val array<float>").toPandas()
    data = data.sort_values(["lang", "doc_id"], kind="stable").reset_index(drop=True)
    langs = sorted(set(data["lang"]))
    if not langs:
        return Codes([], np.zeros((0, 1)), np.zeros((1, BUCKETS)), np.zeros(1), np.ones(1))
    x = np.zeros((len(data), BUCKETS), np.float32)
    for i, (col, val) in enumerate(zip(data["col"], data["val"])):
        x[i, col] = val
    y = data["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    matrix = code_matrix(len(langs))
    target = matrix[y]
    inverse = np.linalg.inv((x @ x.T).astype(np.float64) + 1 + RIDGE * np.eye(len(x)))
    alpha = inverse @ target
    left_out = target - alpha / np.diag(inverse)[:, None]
    trust = np.maximum(1e-3, 2 * (left_out * target > 0).mean(axis=0) - 1)
    return Codes(langs, matrix, SHARPNESS * (alpha.T @ x), SHARPNESS * alpha.sum(axis=0), trust / trust.mean())


def has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(codes: Codes):
    def run(batches):
        for pdf in batches:
            lang, score, ambiguous = [UNKNOWN] * len(pdf), np.zeros(len(pdf)), np.zeros(len(pdf), bool)
            texts = pdf["text"].to_list()
            some = [i for i, t in enumerate(texts) if has_letter(t)]
            for a in range(0, len(some), 256):
                at = some[a : a + 256]
                names, share, margin = codes.decode(np.stack([features(texts[i]) for i in at]))
                for i, name in zip(at, names):
                    lang[i] = name
                score[at], ambiguous[at] = share, margin < AMBIGUOUS
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "lang_pred": lang, "score": score, "ambiguous": ambiguous})

    return run


def predict_language(df: DataFrame, codes: Codes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, lang_pred, score (the language's share, 0 to 1), ambiguous.

    Whole texts count. Null texts and texts without a letter are "und" with score 0; of equally near languages the first by name
    is taken. Null and repeated ids keep their rows, an empty table gives an empty one, and other columns of df are not
    looked at. Nothing is shuffled, and a text of any length is one task's, counted STRIP bytes at a time.
    """
    share_code(df.sparkSession)
    return text_frame(df, id_col, text_col).mapInPandas(_predict(codes), "doc_id long, lang_pred string, score double, ambiguous boolean")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
