"""Texts of a megabyte and more, which are taken in pieces, through the operators."""

import base64
import hashlib
import itertools

import numpy as np
import pytest
from test_text_ops import docs, plain_components, plain_dedup, words_of

from arclet.llm import decontaminate, line_chunks, ngram_join, packing, quality_rules, warc
from arclet.llm.common import GAP_BYTES, PIECE_BYTES, LongText, Words, shingle_sets
from arclet.llm.queries import tokenizer_path


def many_words(seed, n, size=50_000):
    return [f"w{i}" for i in np.random.default_rng(seed).integers(0, size, n)]


@pytest.mark.parametrize("text", [" ".join(many_words(1, 300_000)), " \n" * 700_000 + "tail of\tfive words here", "x" * 1_500_000 + " and é end", " " * 1_200_000])
def test_pieces_hold_the_runs_of_the_whole(text):
    raw = text.encode()
    assert len(raw) > 2 * PIECE_BYTES
    long, whole = LongText(raw, GAP_BYTES), Words(np.frombuffer(raw + b" ", np.uint8), np.array([len(raw) + 1]))
    assert long.count == whole.count == len(words_of(text))
    for width in (1, 2, 5, 40):
        assert (long.runs(width) == whole.runs(width)).all() and len(long.runs(width)) == max(0, whole.count - width + 1)
    assert (long.beginnings(3) == whole.beginnings(3)).all()


def test_shingles_of_long_texts_are_those_of_short_ones():
    words = many_words(2, 250_000)
    long, short = shingle_sets([" ".join(words), " \n ".join(words[100_000:100_040])])
    assert len(long) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and len(short) == 36
    assert np.isin(short, long).all() and not np.isin(next(iter(shingle_sets(["five words that are new"]))), long).any()


def test_long_texts_are_linked_as_all_pairs_are(spark):
    base = many_words(3, 200_000)
    edited, half = list(base), base[:150_000] + many_words(4, 50_000)
    for i in range(0, len(edited), 1000):
        edited[i] = f"e{i}"
    # Half: 149,996 of about 250,000 shingles; most: 175,000 of 225,000.
    texts = {9: base, 4: edited, 6: base, 5: half, 3: base[:175_000] + many_words(5, 25_000), 2: many_words(6, 200_000), 1: base[:40], 8: ["short"]}
    texts = {i: " ".join(t) for i, t in texts.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, texts).repartition(4)).collect()}
    assert got == plain_components(texts) and got[9][1] == 3 and got[5][1] == 5


def test_leaks_at_the_edges_of_pieces_are_found(spark):
    words = many_words(7, 300_000)
    text = " ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    at = [0, int(np.searchsorted(ends, PIECE_BYTES)) - 10, int(np.searchsorted(ends, 2 * PIECE_BYTES)) - 20, 300_000 - 40]
    items = docs(spark, {k: ". ".join(words[a : a + 40]).upper() for k, a in enumerate(at)}).withColumnRenamed("doc_id", "item_id")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.find_leaks(docs(spark, {5: text, 6: " ".join(many_words(8, 200_000))}), items).collect()}
    assert got == {(5, k): (a, 40, 1.0) for k, a in enumerate(at)}


def test_quality_of_a_long_text(spark):
    words = many_words(9, 200_000, 300)
    lines = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    lines += lines[:7] + ["#$ %"]
    r = quality_rules.with_figures(docs(spark, {1: "\n".join(lines)})).first()
    every = " ".join(lines).split()
    seen, again = {}, set()
    for i in range(len(every) - 2):
        seen.setdefault(tuple(every[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            again |= {j for i in places for j in range(i, i + 3)}
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(every), sum(map(len, every)), 3, 7, len(again))


def test_a_long_payload_comes_back(spark, tmp_path):
    page = "<p>é</p>" * 400_000
    pages = spark.createDataFrame([(1, "u", page), (2, "v", page), (3, "w", page + " ")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, str(tmp_path / "a")).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == {1: (3_600_000, sha(page), "response", None), 2: (3_600_000, sha(page), "revisit", 1), 3: (3_600_001, sha(page + " "), "response", None)}


def test_lines_of_long_texts(spark):
    part = lambda seed, n: [" ".join(many_words(seed * 100_000 + k, 5)) + "." for k in range(n)]
    shared = part(1, 6000)
    texts = {1: " ".join(part(2, 3000) + shared), 2: " ".join(shared[1000:] + part(3, 3000)), 3: " ".join(part(4, 20) + shared[2500:2540])}
    want = plain_dedup(texts, 50)
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_chunks.dedup_lines(docs(spark, texts), run_words=50, ends=line_chunks.CLAUSES).collect()}
    assert got == want and got[2][1] >= 4900 and got[1][1] == 0


def test_a_long_text_is_cut_into_whole_pieces(spark):
    from tokenizers import Tokenizer

    text = " ".join(many_words(11, 150_000))
    n = len(Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids) + 1
    got = sorted((r.piece, r.start, r.length) for r in packing.pack_documents(docs(spark, {1: text}), tokenizer_path()).collect())
    assert [p for p, _, _ in got] == list(range(-(-n // 4096))) and sum(x for _, _, x in got) == n
    assert [s for _, s, _ in got] == list(itertools.accumulate([0, *(x for _, _, x in got[:-1])])) and all(x == 4096 for _, _, x in got[:-1])
