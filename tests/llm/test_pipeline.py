"""The pipeline's stages on the smallest tables, each against what it should keep."""

import re
import time

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def stages(spark):
    from arclet.llm.common import stored

    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF))
        out.append((name, docs.toPandas().set_index("doc_id"), after.toPandas()))
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, before, after in stages[:-1]:
        assert list(after.columns) == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert set(after.doc_id) <= set(before.index) and len(after) > 0.5 * len(before)


def test_near_copies_leave_one_of_each_group(stages):
    _, before, after = stages[2]
    kept = {d: shingles(t) for d, t in zip(after.doc_id, after.text)}
    first = {}
    for d, s in kept.items():
        for x in s:
            first.setdefault(x, []).append(d)
    pairs = {(a, b) for v in first.values() for a in v for b in v if a < b}
    assert not [p for p in pairs if 100 * len(kept[p[0]] & kept[p[1]]) >= 75 * len(kept[p[0]] | kept[p[1]])]
    gone = {d: shingles(before.text[d]) for d in set(before.index) - set(kept)}
    assert all(any(4 * len(s & shingles(t)) >= 3 * len(s | shingles(t)) for e, t in zip(before.index, before.text) if e != d) for d, s in gone.items())


def test_leaks_are_gone_and_others_stay(stages, spark):
    _, before, after = stages[3]
    items = [set(shingles(re.sub(r"[^\w\s]", " ", r.text.lower()))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = lambda t: any(i <= shingles(re.sub(r"[^\w\s]", " ", t.lower())) for i in items if i)
    assert not any(whole(t) for t in after.text)
    assert len(before) - len(after) <= 2 * sum(whole(t) for t in before.text)


def test_all_that_is_left_is_packed(stages):
    _, before, after = stages[4]
    assert set(after.doc_id) == set(before.index)
    assert (after.groupby("sequence_id").length.sum() <= 4096).all()


def test_run_gives_the_stages_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == len(stages[-1][2]) and got.agg(F.sum("length")).first()[0] == stages[-1][2].length.sum()


def test_runs_side_by_side_leave_each_other_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    from arclet.llm import common

    def run(k):
        with common.own_folders():
            kept = common.stored(spark.range(k))
            common.stored(spark.range(1))
            time.sleep(1)
            common.drop_stored(spark, keep=0 if k == 1 else 2)
            return kept

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(run, (1, 2))
    assert two.count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        one.count()


def table(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_repeated_passages_leave_all_but_one_document(spark):
    words = lambda tag, n: [" ".join(f"{tag}{i}x{j}" for j in range(4)) + "." for i in range(n)]
    passage, base = words("p", 40), words("b", 40)
    texts = {1: passage + words("q", 10), 2: passage + words("r", 16), 3: base, 4: base[:20] + ["other words here now."] + base[21:]}
    texts |= {5: words("s", 40) + passage[:20], 6: words("s", 40) + passage[:20] + words("t", 1), 7: words("b", 40)}
    docs = table(spark, {i: " ".join(t) for i, t in texts.items()})
    out = corpus_pipeline.line_dedup(spark, docs, SF)
    got = {r.doc_id: r for r in out.collect()}
    first = {r.doc_id: r.text for r in docs.collect()}
    assert got[1].text == first[1] and got[3].text == first[3] and 7 not in got, "a copy of which nothing is left goes"
    assert sum("p20x0" in r.text for r in got.values()) == 1 and sum("b10x0" in r.text for r in got.values()) == 1 and "other words here now." in got[4].text
    assert all(r.n_chars == len(r.text) for r in got.values()) and out.columns == docs.columns


def test_toxic_documents_go_and_clean_ones_stay(stages, spark):
    _, before, after = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(after.doc_id)
    assert all(i in kept for i, toxic in labels.items() if not toxic)
    assert sum(i not in kept for i, toxic in labels.items() if toxic) >= 0.5 * sum(labels.values())


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    odd = table(spark, [(None, "a b c d e f."), (None, None), (1, None), (2, ""), (3, "one two three four five six."), (3, "one two three four five six."), (3, "seven eight nine ten eleven."), (4, "x")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        got = out.count()
        # Of the two texts of id 3 the join keeps both, as rows of one id go or stay together.
        assert got == odd.count(), name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
