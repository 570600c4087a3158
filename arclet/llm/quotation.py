"""Dialogue without its quotations: quote levels, links from quoted passages to the messages they come from, reply order.

DataFrame functions only. A line's level is the number of ">" before its text. Lines in a row of one level are a block,
whose text goes on across line ends, so that a quotation that was wrapped anew reads as its original does. The sentences of
blocks, in lower case and with one space between words, are the passages; they meet as hashes. A quoted passage belongs to
the earliest message of its conversation that has it as its own; the message that a turn quotes most, at its lowest level,
is what it replies to. Lines that only say who wrote what follows are part of the quotation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_GAP, let, stored

MARKS = r"^[ \t]*(?:>[ \t]?)*"
#: How lines end that say who wrote what follows.
ATTRIBUTION = r"(?i)(wrote|writes|said|schrieb|a écrit|escribió)[^!?]{0,40}:[ \t]*$"
#: Separators of blocks, of a block's level and text, and of sentences; texts that hold them are cut there too.
BLOCK_CUT, LEVEL_CUT, CUT = "\x02", "\x03", "\x01"
#: Turns are counted in blocks of so many parents and turns, so that no window holds a whole conversation of any length.
BLOCK = 4096
#: Messages in one row of conversations().
MESSAGES = 1000


def quoted_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with lines, an array of (level, body, kind): level 0 for a turn's own lines; kind is "blank", "by" for a line that
    names the author of what follows, or "text". Only texts with a mark are looked at closely."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\r?\n")
    marked = F.contains(text, F.lit(">"))
    level = lambda m: F.length(F.regexp_replace(m, "[^>]", ""))
    read = lambda x: F.struct(level(F.regexp_extract(x, MARKS, 0)).alias("level"), x.alias("body"))
    bare = lambda x: F.struct(x["level"].alias("level"), F.when(x["level"] > 0, F.regexp_replace(x["body"], MARKS, "")).otherwise(x["body"]).alias("body"))
    blank = lambda body: F.btrim(body, F.lit(" \t\n\x0b\f\r")) == ""
    after = lambda own, i, n: F.get(own, i + n)
    deeper = lambda own, x, i: F.coalesce((after(own, i, 1)["level"] > x["level"]) | (blank(after(own, i, 1)["body"]) & (after(own, i, 2)["level"] > x["level"])), F.lit(False))
    kind = lambda own, x, i: F.when(blank(x["body"]), "blank").when(deeper(own, x, i) & x["body"].rlike(ATTRIBUTION), "by").otherwise("text")
    # Lines look at their neighbours in an array that is made once a row; by a column's name it would be made again for each line.
    close = let(F.transform(F.transform(lines, read), bare), lambda own: F.transform(own, lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), kind(own, x, i).alias("kind"))))
    plain = F.transform(lines, lambda x: F.struct(F.lit(0).alias("level"), x.alias("body"), F.when(blank(x), "blank").otherwise("text").alias("kind")))
    return df.withColumn("lines", F.when(marked, close).otherwise(plain))


def passages(lines: str = "lines"):
    """Of quoted_lines(): an array of (level, h), the sentences' hashes in order."""
    goes_on = lambda own, x, i: (i > 0) & (F.get(own, i - 1)["kind"] == "text") & (F.get(own, i - 1)["level"] == x["level"])
    part = lambda own, x, i: F.when(x["kind"] != "text", "").when(goes_on(own, x, i), F.concat(F.lit(" "), x["body"])).otherwise(F.concat(F.lit(BLOCK_CUT), x["level"].cast("string"), F.lit(LEVEL_CUT), x["body"]))
    blocks = F.filter(F.split(F.array_join(let(F.col(lines), lambda own: F.transform(own, lambda x, i: part(own, x, i))), ""), BLOCK_CUT), lambda b: b != "")
    plain = lambda t: F.lower(F.trim(F.regexp_replace(t, WORD_GAP, " ")))
    sentences = lambda t: F.filter(F.split(F.regexp_replace(plain(t), "([.!?]) ", f"$1{CUT}"), CUT), lambda s: s != "")
    of = lambda b: F.transform(sentences(F.substring_index(b, LEVEL_CUT, -1)), lambda s: F.struct(F.substring_index(b, LEVEL_CUT, 1).cast("int").alias("level"), F.xxhash64(s).alias("h")))
    return F.flatten(F.transform(blocks, of))


def reply_threads(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of df: conv_id, turn, role, text (own lines only), n_quoted, n_linked (passages), quote_depth,
    parent_turn, reply_order.

    parent_turn: the turn quoted most (ties: the latest), among passages of the lowest level that has a link; without a link,
    the turn before if there is one, else null. A passage can only come from an earlier turn. reply_order counts a
    conversation from 1 by (parent, turn), nulls first: a reply comes after what it answers, and replies to one turn stand
    together. Null texts are empty; rows of a null conversation or turn stay, without links and order. Repeated rows keep a
    row each, and each gets a number of its own, in the order of their texts. An empty table gives an empty one, other columns
    of df are not looked at, and a very long text is one task's. Passages are linked through one row per conversation and
    passage, so one that very many conversations share makes no pairs between them.
    """
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # What a turn quotes takes a close look at turns with a mark only, and of other turns none but those of their conversations.
    near = quoted_lines(rows).withColumn("marked", F.contains(F.coalesce("text", F.lit("")), F.lit(">")))
    depth = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0))
    own = F.array_join(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & (x["kind"] != "by")), lambda x: x["body"]), "\n")
    near = near.withColumn("depth", F.when(F.col("marked"), depth).otherwise(F.lit(0)))
    near = near.withColumn("own", F.when(F.col("depth") > 0, F.btrim(own, F.lit(" \t\r\n"))).otherwise(F.coalesce("text", F.lit(""))))
    near = near.withColumn("quoted", F.when(F.col("depth") > 0, F.filter(passages(), lambda x: x["level"] > 0)))
    rows = near.withColumn("n_quoted", F.coalesce(F.size("quoted"), F.lit(0)).cast("long")).withColumn("n_quoted", F.greatest("n_quoted", F.lit(0).cast("long"))).drop("lines", "marked")

    keyed = rows.where("conv_id is not null and turn is not null")
    # Only conversations with a quotation need their passages.
    quoting = keyed.where("n_quoted > 0").select("conv_id", "turn", F.explode_outer("quoted").alias("x")).select("conv_id", "turn", "x.level", "x.h")
    mine = keyed.select("conv_id", "turn", "text").join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    mine = quoted_lines(mine).select("conv_id", F.col("turn").alias("origin"), F.explode_outer(passages()).alias("x")).where("x.level = 0").select("conv_id", "origin", "x.h")
    origins = mine.groupBy("conv_id", "h").agg(F.min("origin").alias("origin"))
    links = quoting.join(origins, ["conv_id", "h"]).where("origin < turn")
    votes = links.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("votes"))
    parents = votes.groupBy("conv_id", "turn").agg(F.sum("votes").alias("linked"), F.min(F.struct("level", (-F.col("votes")).alias("v"), (-F.col("origin")).alias("o"))).alias("best"))
    parents = stored(parents.select("conv_id", "turn", "linked", (-F.col("best.o")).alias("quoted")))

    there = keyed.select("conv_id", F.col("turn").alias("before")).distinct().withColumn("turn", F.col("before") + 1)
    columns = ["conv_id", "turn", "role", F.col("own").alias("text"), "n_quoted", F.col("depth").cast("long").alias("quote_depth")]
    out = keyed.select(*columns).join(parents, ["conv_id", "turn"], "left").join(there, ["conv_id", "turn"], "left")
    out = out.withColumn("n_linked", F.coalesce("linked", F.lit(0)).cast("long")).withColumn("parent_turn", F.coalesce("quoted", "before"))
    # Places: of a block of parents in the conversation, of a parent and a block of its replies in that, of a turn in that.
    out = out.withColumn("pb", F.floor(F.col("parent_turn") / BLOCK)).withColumn("tb", F.floor(F.col("turn") / BLOCK))
    group = ["conv_id", "pb", "parent_turn", "tb"]
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = out.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    inner = counts.withColumn("inner", before(W.partitionBy("conv_id", "pb").orderBy(F.asc_nulls_first("parent_turn"), "tb")))
    outer = counts.groupBy("conv_id", "pb").agg(F.sum("n").alias("n")).withColumn("outer", before(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("pb"))))
    first = inner.alias("i").join(outer.alias("o"), [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in group[:2]]).select(*[F.col(f"i.{k}").alias(f"g_{k}") for k in group], (F.col("inner") + F.col("outer")).alias("first"))
    own_place = F.row_number().over(W.partitionBy(*group).orderBy("turn", F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    placed = out.withColumn("place", own_place).join(first, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in group])
    final = ["conv_id", "turn", "role", "text", "n_quoted", "n_linked", "quote_depth", "parent_turn"]
    rest = rows.where("conv_id is null or turn is null").select(*columns).withColumn("n_linked", F.lit(0).cast("long"))
    none = F.lit(None).cast("long")
    return placed.select(*final, (F.col("first") + F.col("place")).cast("long").alias("reply_order")).unionByName(
        rest.withColumn("parent_turn", none).select(*final, none.alias("reply_order"))
    )


def conversations(threads: DataFrame) -> DataFrame:
    """Of reply_threads(): conversations as rows (conv_id, part, messages) of at most MESSAGES messages (turn, role, text) in reply
    order; a longer conversation has several parts, from 0. Rows without an order are left out."""
    placed = threads.where("reply_order is not null").withColumn("part", F.floor((F.col("reply_order") - 1) / MESSAGES))
    whole = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("reply_order", "turn", "role", "text"))).alias("m"))
    return whole.select("conv_id", "part", F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in ("turn", "role", "text")])).alias("messages"))


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, * FROM (SELECT conv_id, turn, role, text FROM conversations)),
s AS (SELECT *, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM t),
l AS (SELECT rid, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM s),
m AS (SELECT *, length(regexp_replace(regexp_extract(x, '{MARKS}'), '[^>]', '', 'g')) AS level FROM l),
n AS (SELECT *, CASE WHEN level > 0 THEN regexp_replace(x, '{MARKS}', '') ELSE x END AS body FROM m),
b AS (SELECT *, regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g') = '' AS blank FROM n),
k AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN regexp_matches(body, '{ATTRIBUTION}') AND coalesce(lead(level) OVER w > level OR (lead(blank) OVER w AND lead(level, 2) OVER w > level), false) THEN 'by' ELSE 'text' END AS kind
      FROM b WINDOW w AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT *, CASE WHEN kind = 'text' AND coalesce(lag(kind) OVER w = 'text' AND lag(level) OVER w = level, false) THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY rid ORDER BY i)),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS block FROM c),
e AS (SELECT rid, level, block, lower(trim(regexp_replace(string_agg(body, ' ' ORDER BY i), '[\x20\x09-\x0D]+', ' ', 'g'))) AS plain FROM d WHERE kind = 'text' GROUP BY rid, level, block),
p AS (SELECT rid, level, unnest(list_filter(string_split(regexp_replace(plain, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '')) AS h FROM e),
r AS (SELECT rid, max(level)::BIGINT AS quote_depth, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND kind <> 'by'), ''), ' ' || chr(9) || chr(10) || chr(13)) AS cut FROM k GROUP BY rid),
q AS (SELECT t.*, quote_depth, CASE WHEN quote_depth > 0 THEN cut ELSE coalesce(text, '') END AS own, (SELECT count(*) FROM p WHERE p.rid = t.rid AND level > 0) AS n_quoted FROM t JOIN r USING (rid)),
u AS (SELECT conv_id, turn, level, h FROM p JOIN q USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT conv_id, h, min(turn) AS origin FROM u WHERE level = 0 GROUP BY ALL),
v AS (SELECT u.conv_id, u.turn, level, origin, count(*) AS votes FROM u JOIN o ON o.conv_id = u.conv_id AND o.h = u.h WHERE level > 0 AND origin < u.turn GROUP BY ALL),
x AS (SELECT conv_id, turn, sum(votes)::BIGINT AS linked, arg_min(origin, (level, -votes, -origin)) AS quoted FROM v GROUP BY ALL),
a AS (SELECT q.*, coalesce(linked, 0)::BIGINT AS n_linked, coalesce(quoted, f.turn) AS parent_turn
      FROM q LEFT JOIN x ON x.conv_id = q.conv_id AND x.turn = q.turn
      LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) f ON f.conv_id = q.conv_id AND f.turn = q.turn - 1)
SELECT conv_id, turn, role, own AS text, n_quoted, n_linked, quote_depth, parent_turn,
       CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY parent_turn NULLS FIRST, turn, role NULLS FIRST, own NULLS FIRST) END AS reply_order FROM a"""
