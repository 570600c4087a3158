"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list becomes a filter of 512-bit blocks: a URL's hash names one block and one bit in each of its eight words. The filter
is a table with a row for each block, made by one aggregate and met by a join on the block's number, which is broadcast
while its size, known before it is made, stays within a bound. URLs that it lets pass may be listed; an exact hash join
with the list itself says which are. All others never leave their task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS, WORD_BITS = 8, 64
#: Bits of the filter for each listed URL: about 1 in 1,000 others passes.
BITS_A_URL = 16
#: Bytes that a block takes when it is broadcast, and what all may take; a larger filter meets the URLs in a shuffle.
BLOCK_BYTES = 160
BROADCAST_BYTES = 128 << 20
#: Rules are compiled into the projection.
MAX_RULES = 1000
#: Query parameters that don't say what is read.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|msclkid)(=|$)"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, number sign or the end, A-Z as small letters; else empty."""
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands after the host up to a question mark, number sign or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """A URL without what doesn't say what is read: scheme, www., default port, repeated and last slashes, fragment, tracking
    parameters and the order of the others. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "/$", "")
    given = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule, as written host + path, that fits, and its action; null where none does.

    rules: (action, host, path). A rule fits its host and subdomains if the path starts with its own; of equally long ones
    the first by text wins, then block before allow. Beyond MAX_RULES is an error.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled; list URLs instead")
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0] != "block"), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _place(canon: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A URL's block and its bit in each word."""
    h = F.xxhash64(canon)
    again = F.xxhash64(h, F.lit(1))
    return F.pmod(h, F.lit(blocks)), [F.shiftrightunsigned(again, 6 * i).bitwiseAND(WORD_BITS - 1).cast("int") for i in range(WORDS)]


def block_count(urls: int, bits: int = BITS_A_URL) -> int:
    return max(1, -(-urls * bits // (WORDS * WORD_BITS)))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block and w0 to w7 of the filter of listed (canon): a row for each block that has a bit."""
    block, bits = _place(F.col("canon"), blocks)
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    return listed.select(block.alias("block"), *[one(b).alias(f"w{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(
    df: DataFrame, listed: DataFrame, rules=(), id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", bits: int = BITS_A_URL, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """A row per row of df: page_id, host, path, rule, verdict (allow or block), canonical.

    A rule that fits decides; else a URL is blocked if its canonical form is that of a URL in listed (any column name, raw
    URLs). A null URL, or one without ://, has an empty host and path, no canonical form, and is allowed where no rule fits. Null
    and repeated ids keep their rows; nulls and repeats in listed count once or not at all; an empty list blocks nothing, an
    empty table gives an empty one. Other columns are not looked at, whatever their names.

    URLs that the filter turns away are not shuffled. The exact join splits a canonical form that very many rows share, as
    the list has it once.
    """
    keys = stored(listed.select(canonical_url(F.col(listed_col).cast("string")).alias("canon")).where("canon is not null").distinct())
    blocks = block_count(keys.count(), bits)
    table = bloom_blocks(keys, blocks)
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    rows = rows.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), canonical_url(F.col("_url")).alias("canonical"))
    rule, action = rule_for(F.col("host"), F.col("path"), list(rules))
    block, marks = _place(F.col("canonical"), blocks)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    # Only where no rule fits does the filter have a say: elsewhere there is no block to look for.
    asked = rows.withColumn("block", F.when(F.col("action").isNull() & F.col("canonical").isNotNull(), block).otherwise(-1))
    asked = asked.join(F.broadcast(table) if blocks * BLOCK_BYTES <= broadcast_bytes else table, "block", "left")
    hit = reduce(lambda a, b: a & b, [F.call_function("shiftrightunsigned", F.col(f"w{i}"), m).bitwiseAND(F.lit(1).cast("long")) == 1 for i, m in enumerate(marks)])
    passed = asked.select("page_id", "host", "path", "rule", "action", "canonical", F.coalesce(hit, F.lit(False)).alias("possible"))
    turned = passed.where("not possible").withColumn("verdict", F.coalesce("action", F.lit("allow")))
    found = passed.where("possible").join(keys.select(F.col("canon").alias("canonical"), F.lit("block").alias("verdict")), "canonical", "left")
    found = found.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    out = ["page_id", "host", "path", "rule", "verdict", "canonical"]
    return turned.select(out).unionByName(found.select(out))


#: Words of the names of hosts whose pages are listed where no list is given.
UNWANTED = ("adult", "ads", "bets", "casino", "pills", "porn", "spam")


def unwanted_urls(df: DataFrame, url_col: str = "url", words=UNWANTED) -> DataFrame:
    """The URLs of df on hosts one of whose names' parts is such a word: a list that grows with the crawl."""
    return df.select(F.col(url_col).cast("string").alias("url")).where(host_of(F.col("url")).rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)"))
