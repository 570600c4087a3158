"""Events across trials: alignment, shifts, buckets, classification, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def align_events(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Samples (trial, line_id, sample_idx, v) of every trial in the intervals (line_id, event_id, s, e) found in one."""
    met = samples.join(events.select("line_id", "event_id", "s", "e"), "line_id").where("sample_idx >= s and sample_idx < e")
    return met.select("line_id", "event_id", "trial", (F.col("sample_idx") - F.col("s")).alias("pos"), "v")


def peak_shifts(aligned: DataFrame, reference: int = 0) -> DataFrame:
    """line_id, event_id, trial, shift: how far each trial's first highest sample lies from the reference trial's."""
    best = F.max(F.struct("v", (-F.col("pos")).alias("i")))
    peaks = aligned.groupBy("line_id", "event_id", "trial").agg((-best["i"]).alias("peak"))
    ref = peaks.where(F.col("trial") == reference).select("line_id", "event_id", F.col("peak").alias("ref"))
    return peaks.join(ref, ["line_id", "event_id"]).select("line_id", "event_id", "trial", F.abs(F.col("peak") - F.col("ref")).alias("shift"))


def event_asymmetry(aligned: DataFrame) -> DataFrame:
    """line_id, event_id, trial, asymmetry of the aligned slices; see series.asymmetry."""
    from .series import asymmetry

    return asymmetry(aligned.withColumnRenamed("pos", "sample_idx"), ("line_id", "event_id", "trial"))


def asymmetry_buckets(rows: DataFrame, value: str = "asymmetry") -> DataFrame:
    """rows with bucket: whole hundredths of the value."""
    return rows.withColumn("bucket", F.floor(F.col(value) * 100))


def bucket_statistics(rows: DataFrame, value: str, bucket: str = "bucket") -> DataFrame:
    """bucket, mean, deviation (of the population), n."""
    return rows.groupBy(bucket).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(F.lit(1)).alias("n"))


def classification(rows: DataFrame, groups: int, value: str = "asymmetry") -> DataFrame:
    """rows with class: how many of the groups' widths the value lies above the least, rounded half to even; groups + 1 classes at most.

    The extremes are one row, joined by broadcast. Equal values all are class 0.
    """
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    wide = (F.col("_hi") - F.col("_lo")) / groups
    k = F.bround(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), wide), F.lit(0.0))).cast("int")
    return rows.crossJoin(F.broadcast(ends)).withColumn("class", k).drop("_lo", "_hi")


def merge_buckets(rows: DataFrame, keys, column: str = "class") -> DataFrame:
    return rows.where(F.col(column).isin(list(keys)))


def append_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """A bag union by name; also of batches of curves."""
    return a.unionByName(b)


def shift_histogram(shifts: DataFrame, density: int = 20) -> DataFrame:
    """trial, bin, n: counts of shifts by whole numbers; the last bin has its upper edge too, greater shifts are left out."""
    kept = shifts.where(F.col("shift") <= density).withColumn("bin", F.least(F.col("shift"), F.lit(density - 1)))
    return kept.groupBy("trial", "bin").agg(F.count(F.lit(1)).alias("n"))


def bucket_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement: a feature to look at some curves of a bucket."""
    return rows.orderBy(F.rand(seed)).limit(n)


def bucket_samples(rows: DataFrame, n: int, seed: int, bucket: str = "class", keys=("line_id",)) -> DataFrame:
    """n rows of every bucket without replacement: those whose keys' hash with a seed is least, so that the same are drawn whatever
    the partitions. Each task sends n rows of a bucket at most."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
    nth = F.row_number().over(W.partitionBy(bucket).orderBy(mark, *keys))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def normalized_sample(curve: DataFrame, keys=("line_id", "event_id")) -> DataFrame:
    """keys, pos, v: the least value at 0, turned round if it starts no lower than it ends, the peak at pos 0."""
    w = W.partitionBy(*keys)
    c = curve.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_v", F.col("v") - F.min("v").over(w))
    c = c.withColumn("_first", F.min_by("v", "pos").over(w)).withColumn("_last", F.max_by("v", "pos").over(w))
    c = c.withColumn("_p", F.when(F.col("_first") >= F.col("_last"), F.col("_n") - 1 - F.col("pos")).otherwise(F.col("pos")))
    c = c.withColumn("_top", -F.max(F.struct("_v", (-F.col("_p")).alias("i"))).over(w)["i"])
    return c.select(*keys, (F.col("_p") - F.col("_top")).alias("pos"), F.col("_v").alias("v"))


def curve_matrix(samples: DataFrame, trials) -> DataFrame:
    """line_id, sample_idx and a column trial_<i> for each trial."""
    wide = samples.groupBy("line_id", "sample_idx").pivot("trial", list(trials)).agg(F.first("v"))
    return wide.select("line_id", "sample_idx", *[F.col(str(t)).alias(f"trial_{t}") for t in trials])


def bulk_analysis(samples: DataFrame, events: DataFrame, reference: int = 0) -> DataFrame:
    """line_id, event_id, trial, shift, asymmetry for all events and trials."""
    aligned = align_events(samples, events)
    return peak_shifts(aligned, reference).join(event_asymmetry(aligned), ["line_id", "event_id", "trial"])
