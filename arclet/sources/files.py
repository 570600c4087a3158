"""Files: native-endian binary tables, parameter documents, FITS images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.model import DOCUMENTS
from ..plans.session import file_system, share_code


def read_stars(spark: SparkSession, path: str) -> DataFrame:
    """star_id, x, y, mass from files of (x, y, mass) doubles; numbers follow the files by name, and go on from one to the next.

    A file a task, through any store that Spark reads; formats.read_table() reads parts of large files.
    """

    def rows(batches):
        for pdf in batches:
            for first, content in zip(pdf["first"], pdf["content"]):
                a = np.frombuffer(content, np.float64).reshape(-1, 3)
                yield pd.DataFrame({"star_id": np.arange(len(a)) + first, "x": a[:, 0], "y": a[:, 1], "mass": a[:, 2]})

    share_code(spark)
    files = spark.read.format("binaryFile").load(path)
    # A row for each file, without its bytes.
    before = F.sum(F.floor(F.col("length") / 24)).over(Window.orderBy("path")) - F.floor(F.col("length") / 24)
    firsts = files.select("path", "length").withColumn("first", before).select("path", "first")
    return files.select("path", "content").join(firsts, "path").select("first", "content").mapInPandas(rows, "star_id long, x double, y double, mass double")


def write_binary(df: DataFrame, path: str, order, columns, kind=np.float64, head: bytes = b"", tail: bytes = b"") -> None:
    """One file of columns' values, row by row in an order, between a head and a tail. Spark sorts; the driver passes on one partition at a time."""
    share_code(df.sparkSession)

    def chunks(batches):
        for pdf in batches:
            yield pd.DataFrame({"chunk": [pdf.to_numpy(kind).tobytes()]})

    files, where = file_system(df.sparkSession, path)
    out = files.create(where, True)
    try:
        out.write(head)
        for r in df.orderBy(*order).select(*columns).mapInPandas(chunks, "chunk binary").toLocalIterator():
            out.write(bytes(r.chunk))
        out.write(tail)
    finally:
        out.close()


def write_stars(stars: DataFrame, path: str) -> None:
    """What read_stars() reads."""
    write_binary(stars, path, ["star_id"], ["x", "y", "mass"])


def read_points(spark: SparkSession, path: str, curves: int) -> DataFrame:
    """curve_id, sample_idx, qx, qy from a file of so many int32 lengths, then (x, y) doubles curve by curve."""

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                n = np.frombuffer(content, np.int32, curves)
                a = np.frombuffer(content, np.float64, 2 * int(n.sum()), 4 * curves).reshape(-1, 2)
                curve = np.repeat(np.arange(curves), n)
                idx = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"curve_id": curve, "sample_idx": idx.astype(np.int32), "qx": a[:, 0], "qy": a[:, 1]})

    share_code(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "curve_id long, sample_idx int, qx double, qy double")


def write_points(points: DataFrame, path: str) -> None:
    """What read_points() reads: curves in the order of their ids; their lengths, one number each, are held by the driver."""
    lengths = points.groupBy("curve_id").count().orderBy("curve_id").toArrow()["count"].to_numpy()
    write_binary(points, path, ["curve_id", "sample_idx"], ["qx", "qy"], head=lengths.astype(np.int32).tobytes())


def read_values(spark: SparkSession, path: str, nx: int) -> DataFrame:
    """px, py, value from files of doubles, row by row."""

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                v = np.frombuffer(content, np.float64)
                i = np.arange(len(v))
                yield pd.DataFrame({"px": (i % nx).astype(np.int32), "py": (i // nx).astype(np.int32), "value": v})

    share_code(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "px int, py int, value double")


def write_values(values: DataFrame, path: str) -> None:
    """What read_values() reads: a dense map (px, py, value)."""
    write_binary(values, path, ["py", "px"], ["value"])


def kind_of(path: str) -> str:
    return next((k for k in (*DOCUMENTS, ".res") if path.rstrip("/").endswith(k)), "")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per parameter document, by the schema of its ending. Text is never run; a variation script is not read."""
    if kind_of(path) not in DOCUMENTS:
        raise ValueError(f"{path} is no parameter document: {', '.join(DOCUMENTS)}")
    return spark.read.schema(DOCUMENTS[kind_of(path)]).option("multiLine", True).json(path)


def document_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def write_document(df: DataFrame, path: str) -> None:
    document_json(df).coalesce(1).write.text(path)


def fits_head(shape, header: dict | None = None) -> bytes:
    """The header of a FITS file of one image of doubles."""
    cards = [("SIMPLE", "T"), ("BITPIX", "-64"), ("NAXIS", str(len(shape)))]
    cards += [(f"NAXIS{i + 1}", str(n)) for i, n in enumerate(reversed(shape))]
    for k, v in (header or {}).items():
        cards.append((k.upper()[:8], "T" if v is True else "F" if v is False else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''").ljust(8) + "'"))
    text = "".join(f"{k:<8}= {v:>20}"[:80].ljust(80) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def fits_bytes(image: np.ndarray, header: dict | None = None) -> bytes:
    """A FITS file of one image, its first axis the slowest."""
    data = np.asarray(image, float).astype(">f8").tobytes()
    return fits_head(np.shape(image), header) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def _fits_value(text: str):
    """The value of a card after its equals sign: a quoted text, or a word up to the comment."""
    text = text.strip()
    if text.startswith("'"):
        body, at = "", 1
        while at < len(text):
            if text[at] == "'" and text[at + 1 : at + 2] != "'":
                break
            body += text[at]
            at += 2 if text[at] == "'" else 1
        return body.rstrip()
    word = text.partition("/")[0].strip()
    if word in ("T", "F"):
        return word == "T"
    try:
        return int(word)
    except ValueError:
        pass
    try:
        return float(word.replace("D", "E"))
    except ValueError:
        return word or None


#: Array types by BITPIX.
FITS_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def fits_image(content: bytes) -> tuple[np.ndarray | None, dict]:
    """The first image of a FITS file, scaled as its header says, and that header; None where it has no axes."""
    header: dict = {}
    at, done = 0, False
    while not done:
        if at >= len(content):
            raise ValueError("a FITS header without an end")
        for card in (content[at + 80 * i : at + 80 * i + 80].decode("ascii", "replace") for i in range(36)):
            if card[:8].rstrip() == "END":
                done = True
                break
            if card[8:10] == "= ":
                header[card[:8].strip()] = _fits_value(card[10:])
        at += 2880
    if header.get("SIMPLE") is not True:
        raise ValueError("no FITS file")
    shape = [header[f"NAXIS{i}"] for i in range(header["NAXIS"], 0, -1)]
    if not shape:
        return None, header
    kind = np.dtype(FITS_TYPES[header["BITPIX"]])
    raw = np.frombuffer(content, kind, int(np.prod(shape)), at).reshape(shape)
    image = raw.astype(float)
    if "BLANK" in header and kind.kind in "iu":
        image[raw == header["BLANK"]] = np.nan
    return image * header.get("BSCALE", 1) + header.get("BZERO", 0), header


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """path, px, py, value of the images of FITS files of two axes (of more, the first plane), a file a task."""

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                image, _ = fits_image(content)
                if image is None:
                    continue
                plane = np.atleast_2d(image.reshape(-1, *image.shape[-2:])[0] if image.ndim > 2 else image)
                for py in range(len(plane)):
                    yield pd.DataFrame({"path": name, "px": np.arange(plane.shape[1], dtype=np.int32), "py": np.int32(py), "value": plane[py]})

    share_code(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, px int, py int, value double")


def write_fits(values: DataFrame, path: str, nx: int, ny: int, header: dict | None = None) -> None:
    """A dense map (px, py, value) as a FITS image; Spark sorts, the driver passes on one partition at a time."""
    write_binary(values, path, ["py", "px"], ["value"], ">f8", fits_head((ny, nx), header), b"\0" * (-8 * nx * ny % 2880))
