"""Removal of repeated multi-line chunks, with boundaries that content alone decides. DataFrame functions only.

The hashes of a text's lines give a rolling hash over two lines each; a chunk starts where it has a local minimum. So a
boundary depends on four lines around it and never on what stands further off, and every chunk but a text's first or last
has two lines or more.

Such chunks miss most of a short passage. So, where asked, every two lines in a row are compared too, and a maximal run of
lines whose pairs all repeat goes if it has enough words.

Chunks meet by hash, as rows of three numbers; texts are shuffled once, to their lists of chunks. There the bytes of what
repeats are compared: a hash that stands for more than one text is told apart by them. Equal bytes meet within a task first, so
what many documents repeat is sent once a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, stored
from .common import let as _let

#: Where a line ends: after a line break; or, as prose often has none, after a clause mark and its space too, so that a passage
#: pasted into the middle of a line still shares its inner lines with other documents.
LINES = r"(\n)"
CLAUSES = r"(\n|[.!?,;:] )"
#: Set at ends to split there, which costs less than a look-behind at every character.
CUT = "\x01"

#: Words of a run of lines that goes wherever it repeats.
RUN_WORDS = 50
#: Stands for an id that is null where a key must not be; such rows' lists are not looked at.
NO_ID = -(1 << 63)


def _lines(text: Column, ends: str = LINES) -> Column:
    """The lines, each with its separator, so that joined they give the text again; an empty text has none."""
    cut = F.split(F.regexp_replace(text, rf"{ends}(?!\z)", f"$1{CUT}"), CUT)
    behind = F.split(text, f"(?:{'|'.join(f'(?<={x})' for x in ends.strip('()').split('|'))})(?!\\z)")
    return F.when(text == "", F.array().cast("array<string>")).when(F.contains(text, F.lit(CUT)), behind).otherwise(cut)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))


def _spans(name: str, more: int = 0) -> Column:
    """Of an array of distinct ascending numbers, the runs of consecutive ones: (start, n_lines), with so many lines more."""
    heads = F.filter(F.transform(name, lambda x, i: F.when((i == 0) | (F.get(name, i - 1) != x - 1), x)), lambda x: x.isNotNull())
    tails = F.filter(F.transform(name, lambda x, i: F.when((i == F.size(name) - 1) | (F.get(name, i + 1) != x + 1), x)), lambda x: x.isNotNull())
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("start"), (b - a + 1 + more).alias("n_lines")))


def _place(start: Column, n_lines, alone) -> Column:
    """One number for where a chunk starts, how many lines it has and whether it goes by itself: places sort by start."""
    return start.cast("long") * F.lit(1 << 32) + n_lines * 2 + alone


def _start(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def _n_lines(place: Column) -> Column:
    return F.shiftright(place.bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")


def _alone(place: Column) -> Column:
    return place.bitwiseAND(F.lit(1)) == 1


def with_chunks(df: DataFrame, text: str = "text", pairs: bool = False, ends: str = LINES) -> DataFrame:
    """Adds chunks, an array of (hash, place, later) that covers all lines; see _place. With pairs, every two lines in a row are
    added, not alone unless they are a chunk. A text has a hash once: later are its places after the first, or null."""
    df = df.withColumn("_hashes", F.transform(_lines(F.coalesce(F.col(text), F.lit("")), ends), lambda x: F.xxhash64(_bare(x))))
    df = df.withColumn("_rolling", F.transform("_hashes", lambda h, i: F.when(i == 0, h).otherwise(F.xxhash64(F.get("_hashes", i - 1), h))))
    n = F.size("_hashes")
    df = df.withColumn("_at", F.transform("_rolling", lambda h, i: (i == 0) | F.coalesce((h < F.get("_rolling", i - 1)) & (h < F.get("_rolling", i + 1)), F.lit(False))))
    df = df.withColumn("_starts", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("_at", i))).otherwise(F.array().cast("array<int>")))
    size = lambda i, k: F.coalesce(F.get("_starts", k + 1), n) - i
    row = lambda h, place: F.struct(h.alias("hash"), place.alias("place"), F.lit(None).cast("array<bigint>").alias("later"))
    chunk = lambda i, m: row(F.xxhash64(F.slice("_hashes", i + 1, m)), _place(i, m, F.lit(1)))
    if not pairs:
        chunks = F.transform("_starts", lambda i, k: chunk(i, size(i, k)))
    else:
        # _rolling at i is the hash of lines i - 1 and i: a chunk if the first starts one and the next line, if any, another.
        whole = lambda i: F.when(F.get("_at", i - 1) & F.coalesce(F.get("_at", i + 1), F.lit(True)), F.lit(1)).otherwise(F.lit(0))
        both = F.slice(F.transform("_rolling", lambda h, i: row(h, _place(i - 1, F.lit(2), whole(i)))), 2, F.greatest(n - 1, F.lit(0)))
        other = F.filter(F.transform("_starts", lambda i, k: F.when(size(i, k) != 2, chunk(i, size(i, k)))), lambda c: c.isNotNull())
        chunks = F.concat(other, both)
    # Equal chunks have equal lines, so without two equal lines in a row no hash occurs twice.
    again = F.size(F.array_distinct("_rolling")) < F.size("_rolling")
    return df.withColumn("chunks", chunks).withColumn("chunks", F.when(again, _let(F.sort_array("chunks"), _first_places)).otherwise(F.col("chunks"))).drop("_hashes", "_rolling", "_at", "_starts")


def _first_places(own: Column) -> Column:
    """Of a sorted array of (hash, place, null) each hash once, with its later places."""
    heads = F.filter(F.transform(own, lambda c, i: F.when((i == 0) | (F.get(own, i - 1)["hash"] != c["hash"]), i)), lambda i: i.isNotNull())
    rest = lambda at, h, k: F.transform(F.slice(own, h + 2, F.coalesce(F.get(at, k + 1), F.size(own)) - h - 1), lambda c: c["place"])
    one = lambda at, h, k: F.struct(F.get(own, h)["hash"].alias("hash"), F.get(own, h)["place"].alias("place"), F.when(F.coalesce(F.get(at, k + 1), F.size(own)) > h + 1, rest(at, h, k)).alias("later"))
    return _let(heads, lambda at: F.transform(at, lambda h, k: one(at, h, k)))


def _digests(lines: Column) -> Column:
    """What tells each line from others of its hash: its bytes, without the white space at its ends."""
    return F.transform(lines, _bare)


def _digest(bares: Column, place: Column) -> Column:
    """Of a chunk, all bytes of its lines; as no line holds a line break, one between lines keeps them apart."""
    return F.array_join(F.slice(bares, _start(place) + 1, _n_lines(place)), "\n")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, run_words: int | None = None, ends: str = LINES) -> DataFrame:
    """df with text_col rewritten, and n_removed_lines, n_removed_chunks added.

    A chunk of min_lines lines or more that occurs more than once, in whatever documents, stays at its first place (the
    smallest id, then the earliest line) and goes elsewhere. Lines are equal if they are byte by byte but for white space
    at their ends. What stays keeps its bytes. run_words: every run of two lines or more with so many words goes too, if each
    two of its lines in a row have an earlier place; each line's first place stays, so that no line is lost. ends: LINES, or
    CLAUSES for prose with few line breaks.

    Null texts and null ids pass unchanged with zero counts, an empty table gives an empty one; a text that only repeats
    becomes empty. Rows of one id and one text are one document, and keep what it keeps; texts that share an id are told
    apart. Columns of df named as the two counts are replaced, any other name is free. The work on a document grows with its
    length times its logarithm at most, and a very long one is one row: its lines are held by one task.
    """
    own = {"n_removed_lines", "n_removed_chunks"}
    columns = [c for c in df.columns if c not in own]
    # Names of this function's own: the text, a key that is never null, and the rest as one value.
    base = df.select(F.col(text_col).alias("text"), F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("id"), F.col(id_col).isNotNull().alias("known"), F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != text_col]).alias("row"))
    many = stored(base.where("known").groupBy("id").count().where("count > 1").select("id"))
    variant = F.lit(0)
    if not many.isEmpty():
        # Texts of one id have a number each, above the number of any line.
        texts = base.join(many, "id", "left_semi").where("known and text is not null").groupBy("id").agg(F.sort_array(F.collect_set(F.xxhash64("text"))).alias("texts"))
        base = base.join(stored(texts), "id", "left")
        variant = F.when(F.col("texts").isNull(), 0).otherwise(F.array_position("texts", F.xxhash64("text")).cast("int") - 1)
    base = base.withColumn("variant", variant)
    docs = base.where("known and text is not null").select("id", "variant", "text")
    # explode_outer, as for explode() the optimiser adds a filter that would repeat all of with_chunks inline.
    chunks = with_chunks(docs, pairs=run_words is not None, ends=ends).select("id", "variant", F.explode_outer("chunks").alias("c"))
    key = ["id"] if many.isEmpty() else ["id", "variant"]
    # A text brings a hash once, however often it repeats there.
    chunks = chunks.select(*key, "c.hash", "c.place", "c.later").where(_n_lines(F.col("place")) >= min_lines)
    # One shuffle finds both the first place and whether there are others. Only rows of one id can have one place twice.
    order = Window.partitionBy("hash").orderBy(*key, "place")
    places = chunks.withColumns({"_nth": F.row_number().over(order), "_next": F.lead("place").over(order)})
    gone = F.col("_nth") > 1
    if len(key) > 1:
        places = places.withColumn("first", F.first(F.struct(*key, "place")).over(order))
        gone = F.col("first") != F.struct(*key, "place")
    places = places.where("_nth > 1 or _next is not null or later is not null").select(*key, F.struct("place", "hash", gone.alias("gone"), "later").alias("c"))
    lists = stored(places.groupBy(*key).agg(F.sort_array((F.collect_set if len(key) > 1 else F.collect_list)("c")).alias("cs")))

    # Later places are entries of their own.
    entry = lambda c, place, gone: F.struct(place.alias("place"), c["hash"].alias("hash"), gone.alias("gone"), F.lit(None).cast("array<bigint>").alias("later"))
    every = F.flatten(F.transform("cs", lambda c: F.concat(F.array(entry(c, c["place"], c["gone"])), F.transform(F.coalesce(c["later"], F.array().cast("array<bigint>")), lambda p: entry(c, p, F.lit(True))))))
    every = F.when(F.exists("cs", lambda c: c["later"].isNotNull()), every).otherwise(F.col("cs"))
    # Lists are much smaller than texts, which therefore need no sorting.
    joined = base.join(lists.hint("shuffle_hash"), key, "left").withColumn("cs", F.when(F.col("known"), every))
    # Bytes decide. This and the removal read one shuffle of the texts: all of the row stays in use here, so that its plan is the same.
    digests = joined.where(F.size("cs") > 0).select(
        "id", (F.xxhash64("row", "known") % 2).alias("all"),
        F.explode_outer(_let(_digests(_lines(F.col("text"), ends)), lambda own: F.transform("cs", lambda c: F.struct(c["hash"].alias("hash"), _digest(own, c["place"]).alias("d"))))).alias("x"),
    )
    bytes_of = digests.groupBy("x.hash", "x.d").agg(F.min("id").alias("low"), F.max("all").alias("all"))
    several = bytes_of.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("all").alias("all")).where("n > 1 and all < 2").select("hash")
    # Of n hashes of 64 bits about n * n / 2 ** 65 pairs collide: 0.03 of 10 ** 9, 27,000 of 10 ** 12.
    wrong = bytes_of.join(F.broadcast(several), "hash", "left_semi").agg(F.collect_list(F.when(F.col("all") < 2, F.struct("hash", "d", "low"))).alias("w")).scalar()
    # The partition number fences these steps off: a filter on a result would else be pushed below them, with all of them inline
    # in lambdas that run once a line.
    fence = F.spark_partition_id() >= 0
    out = joined.withColumn("_wrong", wrong)
    out = out.withColumn("cs", F.when(fence & (F.size("_wrong") > 0) & (F.size("cs") > 0), _told_apart(ends)).otherwise(F.col("cs")))
    out = out.withColumn("_cut", F.when(fence, F.coalesce(F.transform(F.filter("cs", lambda c: c["gone"]), lambda c: c["place"]), F.array().cast("array<bigint>"))))
    out = out.withColumn("_lines", F.when((F.size("_cut") > 0) & fence, _lines(F.col("text"), ends)))
    if run_words is not None:
        lines = lambda r: F.array_join(F.slice("_lines", r["start"] + 1, r["n_lines"]), "")
        enough = lambda r: F.size(F.filter(F.split(lines(r), WORD_GAP), lambda w: w != "")) >= run_words
        starts = F.array_distinct(F.transform(F.filter("_cut", lambda p: _n_lines(p) == 2), _start))
        out = out.withColumn("_starts", F.when(fence, F.sort_array(starts)))
        out = out.withColumn("_runs", F.when(fence, _spans("_starts", 1)))
        out = out.withColumn("_runs", F.when((F.size("_runs") > 0) & fence, F.filter("_runs", enough)).otherwise(F.col("_runs")))
    else:
        out = out.withColumn("_runs", F.slice(_spans("_cut"), 1, 0).cast("array<struct<start:int,n_lines:int>>"))
    chunk = F.transform(F.filter("_cut", _alone), lambda p: F.struct(_start(p).alias("start"), _n_lines(p).alias("n_lines")))
    covered = F.flatten(F.transform(F.concat("_runs", chunk), lambda r: F.sequence(r["start"], r["start"] + r["n_lines"] - 1)))
    out = out.withColumn("_covered", F.when(fence, F.sort_array(F.array_distinct(covered))))
    out = out.withColumn("_cut", F.when(fence, _spans("_covered")))
    # What stays between the chunks that go.
    after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_cut", k - 1)["start"] + F.get("_cut", k - 1)["n_lines"])
    kept = F.transform(F.sequence(F.lit(0), F.size("_cut")), lambda k: F.array_join(F.slice("_lines", after(k) + 1, F.coalesce(F.get("_cut", k)["start"], F.size("_lines")) - after(k)), ""))
    out = out.withColumn("text", F.when((F.size("_cut") > 0) & fence, F.array_join(kept, "")).otherwise(F.col("text")))
    return out.select(
        *[F.col("text").alias(c) if c == text_col else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)],
        F.aggregate("_cut", F.lit(0), lambda s, c: s + c["n_lines"]).alias("n_removed_lines"),
        F.size("_cut").alias("n_removed_chunks"),
    )


def _told_apart(ends: str) -> Column:
    """cs where a hash of _wrong decides by its bytes: gone if a smaller id has the same, or the same stands earlier in the text."""
    digested = lambda own: F.transform("cs", lambda c: F.struct(*[c[x].alias(x) for x in ("place", "hash", "gone", "later")], F.when(F.exists("_wrong", lambda w: w["hash"] == c["hash"]), _digest(own, c["place"])).alias("d")))
    low = lambda c: F.get(F.filter("_wrong", lambda w: (w["hash"] == c["hash"]) & (w["d"] == c["d"])), F.lit(0))["low"]
    earlier = lambda all_, c: F.exists(all_, lambda o: (o["hash"] == c["hash"]) & (o["d"] == c["d"]) & (o["place"] < c["place"]))
    gone = lambda all_, c: F.when(c["d"].isNull(), c["gone"]).otherwise((low(c) < F.col("id")) | earlier(all_, c))
    told = lambda all_: F.transform(all_, lambda c: F.struct(c["place"].alias("place"), c["hash"].alias("hash"), gone(all_, c).alias("gone"), c["later"].alias("later")))
    return _let(_let(_digests(_lines(F.col("text"), ends)), digested), told)
