"""Toxicity categories by a chain of linear classifiers.

Labels say whether a document is toxic. Categories come from columns of the labels where there are any; else they are kinds
of toxic documents, found by grouping those of the sample by the words that tell them from others. The chain goes through
the categories and ends with toxic itself: each model sees the words and the probabilities of all categories before it.
While fitting, these probabilities are out of fold, and the words of a fold's model are chosen without that fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, share_code, stored, text_frame
from .linear import Sparse, fit, kinds, sigmoid

#: Labelled documents that the chain is fitted on at most: those whose hashed ids are smallest.
TRAIN_ROWS = 16_000
#: A word, or its first BEGINNING bytes, is a feature if its share of labelled documents differs between labels by so many
#: standard errors, and if so many of them hold it.
WORD_Z = 6.0
WORD_DOCUMENTS = 3
BEGINNING = 5
#: Features that a chain has at most: those that differ most.
MAX_WORDS = 16_384
FOLDS = 4
#: Kinds of toxic documents, where labels name no categories.
KINDS = 3


def _word_hashes(texts):
    """For each piece of texts: first text, number of texts, and of each word and beginning its text's number and hash."""
    for start, stop, words in pieces(texts, plain=True):
        row = np.repeat(np.arange(stop - start), words.word_ends - words.word_starts)
        yield start, stop - start, np.tile(row, 2), np.concatenate((words.runs(1), words.beginnings(BEGINNING)))


def _distinct(batches):
    for pdf in batches:
        for start, n, row, h in _word_hashes(pdf["text"]):
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(row.size, bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[new], h[new]
            ends = np.searchsorted(row, np.arange(n), side="right")
            part = pdf.iloc[start : start + n]
            yield pd.DataFrame({"y": part["y"].to_numpy(), "fold": part["fold"].to_numpy(), "words": np.split(h.view(np.int64), ends[:-1])})


@dataclass
class Chain:
    """words: sorted hashes; weights: of each category its words'; before: of each its earlier categories' probabilities'."""

    names: list[str]
    words: np.ndarray
    weights: np.ndarray
    before: list[np.ndarray]
    bias: np.ndarray

    def score(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n, categories) of n texts from the distinct (text, word number) that they hold."""
        p = np.zeros((n, len(self.names)))
        for c in range(len(self.names)):
            p[:, c] = sigmoid(np.bincount(row, self.weights[c][col], n) + self.bias[c] + p[:, :c] @ self.before[c])
        return p


def _sample(labels: DataFrame, n: int) -> DataFrame:
    return labels.where("doc_id is not null and y is not null").orderBy(F.xxhash64("doc_id"), "doc_id", *[c for c in labels.columns if c != "doc_id"]).limit(n)


def _labels(df: DataFrame, id_col: str, label_col: str, categories) -> DataFrame:
    """doc_id, y and a column of 0 or 1 for each category; any number but 0 is 1, and of an id's labels the largest counts."""
    one = lambda c: (F.col(c) != 0).cast("int")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), one(label_col).alias("y"), *[F.coalesce(one(c), F.lit(0)).alias(f"c{i}") for i, c in enumerate(categories)])
    return rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in rows.columns if c != "doc_id"])


def fit_chain(labelled: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", categories=(), train_rows: int = TRAIN_ROWS) -> Chain:
    """Fits the chain on labelled rows (id, text, label 0/1); rows of null id, text or label are left out.

    categories: columns of 0/1 that come before the label in the chain; without them, kinds of toxic documents do.
    At most train_rows rows are used, and MAX_WORDS features, documented bounds. Without rows of both labels no word is a
    feature and the chain says the base rate.
    """
    labels = _labels(labelled.where(F.col(text_col).isNotNull()), id_col, label_col, categories)
    sample = _sample(labels, train_rows)
    texts = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _fit(texts.join(F.broadcast(sample), "doc_id"), list(categories))


def toxic_chain(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, categories=()) -> Chain:
    """The chain for documents (doc_id, text) with labels (doc_id, toxic): the sample of labels is drawn first, so that what is
    broadcast to the texts has train_rows rows at most. Of labels that share an id the largest counts, whatever the order, and null
    labels and ids are left out; rows of documents that share an id are learned from each, and null texts not at all."""
    sample = _sample(_labels(labels, "doc_id", "toxic", categories), train_rows)
    return _fit(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), list(categories))


def _held(words: np.ndarray):
    """Of each labelled text the numbers of the given words (sorted hashes) that it holds."""

    def run(batches):
        for pdf in batches:
            for start, n, row, h in _word_hashes(pdf["text"]):
                at = np.minimum(np.searchsorted(words, h), max(words.size - 1, 0))
                hit = words[at] == h if words.size else np.zeros(h.size, bool)
                pair = np.unique(row[hit] * np.int64(words.size + 1) + at[hit])
                ends = np.searchsorted(pair // (words.size + 1), np.arange(n), side="right")
                own = np.split((pair % (words.size + 1)).astype(np.int32), ends[:-1])
                yield pdf.iloc[start : start + n].drop(columns="text").assign(words=own)

    return run


def _telling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that tell labels apart, and (FOLDS + 1, words): whether each does without each fold, and at all."""
    sizes = {r.fold: (r.n, r.n1) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).collect()}
    held = rows.mapInPandas(_distinct, "y int, fold int, words array<long>").select("y", "fold", F.explode("words").alias("h"))
    of = lambda k: F.col("fold") == k
    counts = held.groupBy("h").agg(*[F.count(F.when(of(k), 1)).alias(f"d{k}") for k in range(FOLDS)], *[F.coalesce(F.sum(F.when(of(k), F.col("y"))), F.lit(0)).alias(f"t{k}") for k in range(FOLDS)])

    def score(without: int):
        n, n1 = (sum(sizes.get(k, (0, 0))[i] for k in range(FOLDS) if k != without) for i in (0, 1))
        if not 0 < n1 < n:
            return F.lit(0.0)
        d, d1 = (sum((F.col(f"{c}{k}") for k in range(FOLDS) if k != without), F.lit(0)) for c in "dt")
        rate = d / float(n)
        gap = F.abs(d1 / float(n1) - (d - d1) / float(n - n1))
        return F.when(d >= WORD_DOCUMENTS, gap / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / n1 + 1 / (n - n1)))).otherwise(F.lit(0.0))

    z = counts.select("h", F.array(*[score(k) for k in range(FOLDS + 1)]).alias("z")).where(F.array_max("z") >= WORD_Z)
    got = sorted((r.h & ((1 << 64) - 1), r.z) for r in z.orderBy(F.desc(F.array_max("z")), "h").limit(MAX_WORDS).collect())
    chosen = np.array([x for _, x in got]).reshape(len(got), FOLDS + 1).T >= WORD_Z
    return np.array([h for h, _ in got], np.uint64), chosen


def _fit(rows: DataFrame, categories: list[str]) -> Chain:
    """rows: doc_id, text, y and c0, c1, ... Words are counted by Spark; the driver sees those that tell labels apart, and who
    holds them."""
    share_code(rows.sparkSession)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    rows = stored(rows.where("text is not null").withColumn("fold", fold))
    words, chosen = _telling(rows)
    targets = [f"c{i}" for i in range(len(categories))]
    schema = ", ".join(["doc_id long", "y int", *[f"{c} int" for c in targets], "fold int", "words array<int>"])
    data = rows.mapInPandas(_held(words), schema).toPandas().sort_values(["doc_id", "y"]).reset_index(drop=True)
    y, folds = data["y"].to_numpy(np.float64), data["fold"].to_numpy()
    row = np.repeat(np.arange(len(data)), data["words"].map(len).to_numpy().astype(int) if len(data) else 0)
    col = np.concatenate(data["words"].to_list()).astype(int) if len(row) else np.zeros(0, int)
    x = Sparse(row, col, np.ones(len(row)), (len(y), words.size))

    if categories:
        goals = [data[c].to_numpy(np.float64) for c in targets]
    else:
        categories, goals = [f"kind_{j + 1}" for j in range(KINDS)], [np.zeros(len(y)) for _ in range(KINDS)]
        if y.any() and words.size:
            group = kinds(x.take(y > 0).only(chosen[FOLDS]), KINDS)
            for j in range(KINDS):
                goals[j][y > 0] = group == j
    weights, before, bias, earlier = [], [], [], np.zeros((len(y), 0))
    for goal in [*goals, y]:
        # Whatever the words, the earlier probabilities are columns too.
        seen = lambda k: np.concatenate((chosen[k], np.ones(earlier.shape[1], bool))) if words.size else np.ones(earlier.shape[1], bool)  # noqa: B023,E731
        features = x.add(earlier)
        w, b = fit(features.only(seen(FOLDS)), goal)
        weights.append(w[: words.size])
        before.append(w[words.size :])
        bias.append(b)
        out = np.zeros(len(y))
        for k in range(FOLDS):
            part = features.only(seen(k))
            fw, fb = fit(part.take(folds != k), goal[folds != k])
            out[folds == k] = sigmoid(part.take(folds == k).dot(fw) + fb)
        earlier = np.column_stack((earlier, out))
    names = [*categories, "toxic"]
    return Chain(names, words, np.array(weights).reshape(len(names), -1), before, np.array(bias))


def _scores(chain: Chain):
    def run(batches):
        for pdf in batches:
            out = []
            for _, n, row, h in _word_hashes(pdf["text"]):
                if chain.words.size:
                    at = np.minimum(np.searchsorted(chain.words, h), chain.words.size - 1)
                    hit = chain.words[at] == h
                    pair = np.unique(row[hit] * np.int64(chain.words.size) + at[hit])
                    out.append(chain.score(pair // chain.words.size, pair % chain.words.size, n))
                else:
                    out.append(chain.score(np.zeros(0, int), np.zeros(0, int), n))
            p = np.concatenate(out) if out else np.zeros((0, len(chain.names)))
            yield pdf.drop(columns="text").assign(**{f"p_{name}": p[:, c] for c, name in enumerate(chain.names)})

    return run


def score_toxicity(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of df: doc_id, p_<category> of every category, rejected (toxic at the threshold or over; a chain that has
    learned no word rejects nothing).

    A null or blank text gets the base rates of the chain; null and repeated ids keep their rows, an empty table gives an
    empty one, and other columns of df are not looked at. Whole texts count; each distinct word counts once, so that length
    alone moves no score. Nothing is shuffled, and a text of any length is one task's.
    """
    share_code(df.sparkSession)
    cols = ", ".join(f"p_{n} double" for n in chain.names)
    out = text_frame(df, id_col, text_col).mapInPandas(_scores(chain), f"doc_id long, {cols}")
    return out.withColumn("rejected", F.col(f"p_{chain.names[-1]}") >= threshold if chain.words.size else F.lit(False))
