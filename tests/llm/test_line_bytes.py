"""Line dedup where every hash collides, the second ones too: bytes must decide, not another hash."""

from pyspark.sql import functions as F

from arclet.llm import line_chunks


def test_bytes_decide_where_all_hashes_are_equal(spark, monkeypatch):
    texts = {0: "aa. bb. cc. dd.", 1: "ee. ff. gg. hh.", 2: "aa. bb. cc. dd.", 3: "ee. ff. gg. hh. " * 2, 4: "xx. yy. zz. uu."}
    flat = lambda *c: F.length(F.concat_ws("", *[x.cast("string") for x in c if not isinstance(x, str)])).cast("long") if all(not isinstance(x, str) for x in c) else F.lit(1).cast("long")
    monkeypatch.setattr(line_chunks.F, "xxhash64", flat)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words in (None, 2):
        got = {r.doc_id: r.text for r in line_chunks.dedup_lines(df, run_words=words, ends=line_chunks.CLAUSES).collect()}
        assert [got[i] for i in (0, 1, 4)] == [texts[i] for i in (0, 1, 4)]
    assert got[2] == "" and got[3] == ""
