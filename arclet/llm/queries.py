"""The queries of the text operators over the documents, pages and conversations tables, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as rules
from . import quotation
from .decontaminate import find_leaks
from .html_text import extract_text
from .language_id import fit_codes, predict_language
from .lexical_search import rank_documents
from .line_chunks import CLAUSES, LINES, RUN_WORDS, dedup_lines
from .ngram_join import jaccard_components
from .packing import pack_documents
from .toxicity import score_toxicity, toxic_chain
from .url_filter import TRACKING, UNWANTED, judge_urls, unwanted_urls
from .vector_codes import compress_vectors
from .warc import round_trip


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its figures and verdicts."""
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("broken")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn without its quotations, with what it replies to and its place."""
    return quotation.reply_threads(table(spark, sf_dir, "conversations"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: one row for each document and benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability of each category and the verdict."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, toxic_chain(docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; held-out documents are those of which nothing is learned. A null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    codes = fit_codes(docs.where(~held_out))
    return predict_language(docs, codes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract_text(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archive."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=RUN_WORDS, ends=CLAUSES)
    return out.select("doc_id", "text", "n_removed_lines", "n_removed_chunks")


def quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail would have them: a turn quotes the one before it, and every third that one's own predecessor too,
    a level deeper, below a line that says who wrote it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = lambda n: first.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(f"said_{n}"))
    marked = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", f"\n{mark}"), F.lit("\n"))
    outer = F.when(F.col("turn") % 3 == 0, F.coalesce(F.concat(F.lit("> they wrote:\n"), marked("said_2", ">> ")), F.lit(""))).otherwise("")
    whole = F.when(F.col("said_1").isNotNull(), F.concat(F.lit("someone wrote:\n"), outer, marked("said_1", "> "), F.col("text"))).otherwise(F.col("text"))
    rows = turns.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", "role", whole.alias("text"))


def quoted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2, over turns that quote others."""
    return quotation.reply_threads(quoting(spark, sf_dir))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations built from turns that quote others, without the quotations and in reply order."""
    whole = quotation.conversations(quoted_turns(spark, sf_dir))
    message = lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), m["text"])
    return whole.select("conv_id", "part", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", message), "\n").alias("text"))


def line_breaks_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10, with lines that end at line breaks only."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=RUN_WORDS, ends=LINES)
    return out.select("doc_id", "text", "n_removed_lines", "n_removed_chunks")


#: Rules of op11: action, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the list of URLs on unwanted hosts."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, unwanted_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every benchmark item the ten documents that score highest."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's code and its error."""
    return compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_chat_formatting, op3_benchmark_decontamination, op4_toxicity, op5_language_id,
        op6_html_extraction, op7_ngram_jaccard_join, op8_best_fit_packing, op9_warc, op10_line_dedup,
        op11_url_filters, op12_ranked_lexical_search, op13_vector_code_compression, quoted_turns, quoted_conversations, line_breaks_dedup,
    )
}

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS low FROM p),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(x, 5 * g + 1, 5))::INT >> (5 * (3 - k))) % 32, 1), '' ORDER BY g, k) AS b
      FROM d, range(8) AS a(g), range(4) AS b(k) GROUP BY page_id)
SELECT d.page_id, payload_bytes, b AS payload_digest, CASE WHEN low = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN low <> d.page_id THEN low END AS refers_to FROM d JOIN c ON c.page_id = d.page_id"""

_QUOTING = """
WITH f0 AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL),
quoting AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN a.said IS NOT NULL THEN 'someone wrote:' || chr(10)
    || CASE WHEN c.turn % 3 = 0 AND b.said IS NOT NULL THEN '> they wrote:' || chr(10) || '>> ' || replace(b.said, chr(10), chr(10) || '>> ') || chr(10) ELSE '' END
    || '> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10) || c.text ELSE c.text END AS text
  FROM conversations c LEFT JOIN f0 a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN f0 b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
""" + quotation.ORACLE.replace("FROM conversations", "FROM quoting").strip().removeprefix("WITH")

_BUILT = f"""SELECT conv_id, (reply_order - 1) // {quotation.MESSAGES} AS part, count(*) AS n_messages, string_agg(coalesce(role, '') || ': ' || text, chr(10) ORDER BY reply_order) AS text
FROM ({_QUOTING}) WHERE reply_order IS NOT NULL GROUP BY ALL"""

_URLS = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '') AS q FROM pages),
c AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS kept FROM p),
k AS (SELECT page_id, host, path, CASE WHEN h <> '' THEN h || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon
      FROM (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)?$', '') AS h FROM c)),
listed AS (SELECT DISTINCT canon FROM k WHERE regexp_matches(host, '(^|[.-])({'|'.join(UNWANTED)})([.-]|$)')),
rules(action, h, p) AS (VALUES {', '.join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)}),
fit AS (SELECT page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(action, length(r.h || r.p)) AS action
        FROM k JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT k.page_id, host, path, rule, coalesce(action, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN fit ON fit.page_id = k.page_id LEFT JOIN listed ON listed.canon = k.canon"""

_SEARCH = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM n), m AS (SELECT doc_id, 25 + (75 * n * big_n) // l AS m FROM n, s),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, big_n),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
f AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0) WHERE rank <= 10"""


def _vector_sql() -> str:
    """Two rounds and the last assignment; e: entries (part, entry, place, c), a: the nearest entry of every part."""
    nearest = "SELECT vec_id, part, min(dist * 64 + entry) AS best FROM (SELECT x.vec_id, x.part, e.entry, sum((x.x - e.c) * (x.x - e.c))::BIGINT AS dist FROM x JOIN {e} e ON e.part = x.part AND e.place = x.place GROUP BY ALL) GROUP BY ALL"
    mean = """SELECT e.part, e.entry, e.place, coalesce(m.c, e.c) AS c FROM {e} e LEFT JOIN
      (SELECT x.part, a.best % 64 AS entry, x.place, floor(sum(x.x)::DOUBLE / count(*))::BIGINT AS c FROM x JOIN {a} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL) m
      ON m.part = e.part AND m.entry = e.entry AND m.place = e.place"""
    return f"""
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
flat AS (SELECT vec_id, len(v) // 16 AS d, unnest(v) AS c, generate_subscripts(v, 1) - 1 AS i FROM kept),
x AS MATERIALIZED (SELECT vec_id, i // d AS part, i % d AS place, floor(256 * c::DOUBLE)::BIGINT AS x FROM flat),
low AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
e0 AS MATERIALIZED (SELECT part, entry, place, x AS c FROM x JOIN low USING (vec_id)), a0 AS MATERIALIZED ({nearest.format(e="e0")}),
e1 AS MATERIALIZED ({mean.format(e="e0", a="a0")}), a1 AS MATERIALIZED ({nearest.format(e="e1")}),
e2 AS MATERIALIZED ({mean.format(e="e1", a="a1")}), a2 AS MATERIALIZED ({nearest.format(e="e2")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM e2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""


#: For the rest, tests hold the queries against plain Python.
ORACLE: dict[str, str] = {
    "op1_quality_rules": rules.oracle(), "op2_chat_formatting": quotation.ORACLE, "op9_warc": _WARC,
    "op11_url_filters": _URLS, "op12_ranked_lexical_search": _SEARCH, "op13_vector_code_compression": _vector_sql(),
    "quoted_turns": _QUOTING, "quoted_conversations": _BUILT,
}
