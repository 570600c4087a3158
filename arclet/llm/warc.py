"""A content-addressed web archive: payloads once, by a strong digest; record headers apart; records by joins.

The archive is tables in one folder: payloads (key, payload) and headers (page_id, key, and the exact bytes of each record's
head, that of HTTP included). A record is its head, its payload (none for a revisit) and two line ends, and is rebuilt by
joining the two. Reading parses these bytes and verifies lengths, digests and addresses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import file_system
from .common import share_code, shared_dir

#: Payloads of so many bytes and more are written once and then revisited.
LEAST_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CRLF = "\r\n"
#: Of a record's number, whether its page has no id.
NO_PAGE = 1 << 63


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """Of a page's id and its row's number, so that rows that share an id are records each."""
    high = row | (NO_PAGE if page_id is None else 0)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | (page_id or 0) & ((1 << 64) - 1))}>"


def page_of(record: str) -> int | None:
    whole = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = whole & ((1 << 64) - 1)
    return None if whole >> 64 & NO_PAGE else low - (1 << 64) if low >> 63 else low


def target_uri(url: str) -> str:
    """A URL as its header has it: byte by byte, but for what would end the line."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record_head(page_id: int | None, row: int, url: str | None, size: int, sha1: str, first: str | None, date: str = DATE) -> bytes:
    """The head of a WARC 1.1 record of an HTTP answer, up to and with the empty line of the HTTP head. size: bytes of the
    full payload; first: the record that this one revisits, or None for a response."""
    answer = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]) + CRLF * 2
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, row)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + target_uri(url))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {first}"]
    lines.append(f"Content-Length: {len(answer) + (size if first is None else 0)}")
    return (CRLF.join(lines) + CRLF * 2 + answer).encode()


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, those of HTTP and the payload of one record; ValueError if its form or length is wrong."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    if lines[0] != "WARC/1.1" or not gap:
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if fields["WARC-Type"] == "warcinfo":
        return fields, {}, rest[:size]
    head, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:]), payload


def _digests(batches):
    for pdf in batches:
        payloads = [b"" if h is None else h.encode("utf-8", "surrogatepass") for h in pdf["html"]]
        yield pd.DataFrame({"row": pdf["row"], "page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "key": [hashlib.sha256(p).digest() for p in payloads], "sha1": [base32_sha1(p) for p in payloads], "size": [len(p) for p in payloads]})


def _number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _heads(date: str):
    def run(batches):
        for pdf in batches:
            pages, heads = [_number(p) for p in pdf["page_id"]], []
            for page, row, url, size, sha1, first, first_row in zip(pages, pdf["row"], pdf["url"], pdf["size"], pdf["sha1"], pdf["first_page"], pdf["first_row"]):
                heads.append(record_head(page, row, url, size, sha1, None if row == first_row else record_id(_number(first), int(first_row)), date))
            yield pd.DataFrame({"page_id": pd.array(pages, "Int64"), "url": pdf["url"], "key": pdf["key"], "kept": pdf["row"] == pdf["first_row"], "head": heads})

    return run


def _verified(batches):
    for pdf in batches:
        for key, payload, least, most in zip(pdf["key"], pdf["payload"], pdf["least"], pdf["most"]):
            if hashlib.sha256(payload).digest() != key or least != most:
                raise ValueError(f"two payloads share the digest {key.hex()}")
        yield pdf[["key", "payload"]]


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes df's pages as an archive in the folder path, which all executors see: a record for every row.

    The payload is html in UTF-8 (null: empty). Of equal payloads of least_bytes bytes or more the one with the smallest
    page_id is stored, as a response; the others are revisits of it. Null ids come last, and of rows that share an id one is
    first. Payloads move only once each: copies meet as digests, and the first of a payload that very many pages share is
    found before the shuffle. A URL goes into its header as it is, but for line ends, and as it was into the table of headers; date
    is when the pages were fetched. An empty table makes an empty archive, a folder that is there already is an error; other
    columns of df are not looked at. A page, however long, is one task's.
    """
    spark = df.sparkSession
    share_code(spark)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # Rows' numbers are made once, with the table that all else reads.
    numbered = pages.withColumn("row", F.monotonically_increasing_id())
    numbered.mapInPandas(_digests, "row long, page_id long, url string, key binary, sha1 string, size long").write.parquet(f"{path}/seen")
    seen = spark.read.parquet(f"{path}/seen")
    # By id, then by row; ids that are null last.
    firsts = seen.groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A digest that one row has needs no join: its row is its own first.
    shared = seen.join(firsts.select("key", "f"), "key", "left")
    copy = (F.col("size") >= least_bytes) & F.col("f").isNotNull()
    heads = shared.withColumn("first_page", F.when(copy, F.col("f.page_id")).otherwise(F.col("page_id"))).withColumn("first_row", F.when(copy, F.col("f.row")).otherwise(F.col("row")))
    heads.drop("f").mapInPandas(_heads(date), "page_id long, url string, key binary, kept boolean, head binary").write.parquet(f"{path}/headers")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    stored = pages.withColumn("payload", payload).withColumn("key", F.unhex(F.sha2("payload", 256)))
    # Bytes of one digest are compared by a second digest of another family, before and after the shuffle.
    unique = stored.select("key", "payload", F.xxhash64("payload").alias("x")).groupBy("key").agg(F.first("payload").alias("payload"), F.min("x").alias("least"), F.max("x").alias("most"))
    unique.mapInPandas(_verified, "key binary, payload binary").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _read(batches):
    for pdf in batches:
        rows = []
        for record, url, sha1, size in zip(pdf["record"], pdf["url"], pdf["sha1"], pdf["size"]):
            fields, answer, payload = parse_record(record)
            kept = fields["WARC-Type"] == "response"
            said = (fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(answer["Content-Length"]))
            # A revisit's payload is in another record; what is known of it is its digest and size.
            if said != ((base32_sha1(payload), len(payload)) if kept else (sha1, size)):
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not that of its digest")
            if fields.get("WARC-Target-URI") != (None if url is None else target_uri(url)):
                raise ValueError(f"{fields['WARC-Record-ID']} has another URL than its head")
            rows.append((page_of(fields["WARC-Record-ID"]), url, said[1], said[0], fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if not kept else None))
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        yield out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))


def _measured(batches):
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"], "sha1": [base32_sha1(p) for p in pdf["payload"]], "size": [len(p) for p in pdf["payload"]]})


def records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records, rebuilt: page_id, url, key, kept, record (exact bytes). A payload moves once, to the record that has
    it (each, where copies were too short to be revisits)."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    end = F.lit(b"\r\n\r\n")
    kept = heads.where("kept").join(payloads, "key").withColumn("record", F.concat("head", "payload", end))
    others = heads.where("not kept").withColumn("record", F.concat("head", end))
    columns = ["page_id", "url", "key", "kept", "record"]
    return kept.select(columns).unionByName(others.select(columns))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """What the records say: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Every digest is verified: that of a
    revisit by the digest and size of its payload, so that no payload is sent to the records that revisit it."""
    share_code(spark)
    every = records(spark, path)
    sizes = spark.read.parquet(f"{path}/payloads").mapInPandas(_measured, "key binary, sha1 string, size long")
    none = [F.lit(None).cast("string").alias("sha1"), F.lit(0).cast("long").alias("size")]
    rows = every.where("kept").select("record", "url", *none).unionByName(every.where("not kept").join(sizes, "key").select("record", "url", "sha1", "size"))
    return rows.mapInPandas(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_warc(spark: SparkSession, path: str, folder: str, date: str = DATE) -> list[str]:
    """The archive as .warc.gz files in a folder, each a warcinfo record and members of one record each; their paths.

    Records are packed by tasks into members; the driver passes on one task's at a time. A file ends after about 1 GB. Files of
    the same names in the folder are written over; an empty archive makes none.
    """
    share_code(spark)

    def members(batches):
        for pdf in batches:
            yield pd.DataFrame({"chunk": [b"".join(gzip.compress(bytes(r), mtime=0) for r in pdf["record"])]})

    made: list[str] = []
    out, size = None, 0
    for r in records(spark, path).select("record").mapInPandas(members, "chunk binary").toLocalIterator():
        if out is None or size > 1 << 30:
            if out is not None:
                out.close()
            made.append(f"{folder.rstrip('/')}/{len(made):05d}.warc.gz")
            files, where = file_system(spark, made[-1])
            out, size = files.create(where, True), 0
            block = f"software: arclet{CRLF}format: WARC File Format 1.1{CRLF}".encode()
            info = CRLF.join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"])
            out.write(gzip.compress(info.encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0))
        out.write(bytes(r.chunk))
        size += len(r.chunk)
    if out is not None:
        out.close()
    return made


def round_trip(df: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes df's pages to an archive, in a new shared folder by default, and reads it back: a row per row of df; see
    write_archive() for nulls, repeats and columns."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    write_archive(df, path, **columns)
    return read_archive(spark, path)
