"""Quality rules: a table of thresholds compiled into one projection. DataFrame functions only.

Base figures come first, then every rule is one comparison of two of them; no rule runs user code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP

#: Frequent words of the languages that the rules know.
STOP_WORDS = (
    "the be to of and that have with is was for it on as by this are at from or an in "  # English
    "der die das und ist von zu mit den des ein eine nicht auf sich im für dem auch "  # German
    "le la les de des un une et est que qui dans pour pas sur par avec du au en "  # French
    "el los las del que y en un una por con para es se no lo su al"  # Spanish
).split()
SYMBOLS = "[^#*$%&|<>]++"
BULLETS = ("-", "*", "•", "‣", "·")


@dataclass(frozen=True)
class Rule:
    """A text passes if low * over <= value <= high * over; value and over name figures, over "" stands for 1."""

    name: str
    value: str
    over: str = ""
    low: float | None = None
    high: float | None = None


#: The thresholds. Ratios are products, so that no division can meet a zero.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 14),
    Rule("symbol_words", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None),
    Rule("letter_words", "n_letter_words", "n_words", 0.7, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: str, windows: str, order: str) -> Column:
    """Words in three-word windows that occur more than once. order: windows' hashes with places, sorted, or null."""
    places = F.array_sort(
        F.filter(
            F.transform(order, lambda x, i: F.when((F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
    )
    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.get(F.transform(F.array(places), covered), F.lit(0)), F.lit(0))


#: What with_figures() adds.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines")


def with_figures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the figures that rules compare: see quality_rules. Columns of df with a figure's name are replaced, and names that
    start with an underscore are for this function."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn("_t", text)
    df = df.withColumn("_w", F.filter(F.split("_t", WORD_GAP), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    # A window that would reach past the end has nulls; xxhash64 skips them, so the last two are cut.
    df = df.withColumn("_v", F.slice(F.transform("_h", lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2))), 1, F.greatest(F.size("_h") - 2, F.lit(0))))
    # Sorting is for texts with a repeated window only.
    # The partition number fences the steps off: a filter on a verdict would else be pushed below them, with all of them inline.
    order = F.sort_array(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_o", F.when((F.size(F.array_distinct("_v")) < F.size("_v")) & (F.spark_partition_id() >= 0), order))
    count = lambda c, keep: F.size(F.filter(c, keep)).cast("long")
    figures = [
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", WORD_GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_w", "_v", "_o").cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("_w", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS))).alias("n_stop_words"),
        count("_w", lambda w: w.rlike("\\p{L}")).alias("n_letter_words"),
        count("_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin(*BULLETS)).alias("n_bullet_lines"),
        count("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
    ]
    own = {"_t", "_w", "_lines", "_h", "_v", "_o", *FIGURES}
    return df.select(*[c for c in df.columns if c not in own], *figures)


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """An array of the names of the rules that a row of figures breaks."""
    broken = []
    for r in rules:
        over = F.col(r.over) if r.over else F.lit(1)
        bad = F.lit(False)
        if r.low is not None:
            bad |= F.col(r.value) < over * F.lit(r.low)
        if r.high is not None:
            bad |= F.col(r.value) > over * F.lit(r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of df: doc_id, base figures, base_failed, kept, the rules' figures and broken (their names).

    Words are runs without white space, lines parts between line breaks that hold a word. base_failed: fewer than 50 words,
    or more than half of them in three-word windows that the text has more than once; kept: neither that nor a broken rule.
    Null and blank texts have zero figures and fail. One projection over each row: nothing is shuffled, and a text costs its
    length, or its length times its logarithm if windows repeat (windows are told apart by 64-bit hashes).
    """
    rows = with_figures(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("broken", compiled(rules))
    kept = ~F.col("base_failed") & (F.size("broken") == 0)
    figures = [c for c in rows.columns if c not in ("doc_id", "text", "base_failed", "broken", *_BASE)]
    return rows.select("doc_id", *_BASE, "base_failed", kept.alias("kept"), *figures, "broken")


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """quality_rules over documents in DuckDB's SQL, without the column broken."""
    bad = []
    for r in rules:
        over = r.over or "1"
        bad += [f"{r.value} < {over} * {r.low}"] if r.low is not None else []
        bad += [f"{r.value} > {over} * {r.high}"] if r.high is not None else []
    gap = r"[\x20\x09-\x0D]+"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{gap}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{gap}', '', 'g') <> '') AS lines FROM t),
pos AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT doc_id, i, a || ' ' || lead(a) OVER v || ' ' || lead(a, 2) OVER v AS g FROM pos WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({_sql_list(dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')))::BIGINT AS n_letter_words,
             len(list_filter(lines, lambda x: substr(ltrim(x), 1, 1) IN ({_sql_list(BULLETS)})))::BIGINT AS n_bullet_lines,
             len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…'))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(bad) or "false"}) AS kept, n_lines, n_stop_words, n_letter_words, n_bullet_lines, n_ellipsis_lines
FROM b"""
