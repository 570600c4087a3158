"""The text operators on small tables, against plain Python."""

import base64
import gzip
import hashlib
import html
import itertools
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from arclet.llm import decontaminate, html_text, language_id, line_chunks, ngram_join, packing, quality_rules, quotation, toxicity, warc
from arclet.llm.common import shingle_sets
from arclet.llm.components import connected_components
from arclet.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def docs(spark, texts, **extra):
    rows = [(i, t) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def random_words(rng, n, size=3000):
    return [f"w{i}" for i in rng.integers(0, size, n)]


# Components.


def test_components_of_long_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (3, 2)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([(1, None)], "a long, b long")).count() == 0


# Op 1.

QUALITY = ["", None, "   \n\t ", "a b c a b c", "x " * 60, " ".join(f"the of word{i}" for i in range(40)), "line one\nline one\n\nline\n" + "the and " * 30, "é" * 3000 + " b", "#a $b %c " * 30 + "\v\f x"]


def plain_figures(text):
    w = words_of(text or "")
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for p in places.values() if len(p) > 1 for i in p for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_figures_are_those_of_plain_python(spark):
    got = by_id(quality_rules.quality_rules(docs(spark, QUALITY, n_words=5, _w="clash")))
    for i, t in enumerate(QUALITY):
        r, want = got[i], plain_figures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert got[5].kept and not got[5].broken


def test_figures_replace_columns_of_their_names(spark):
    out = quality_rules.with_figures(docs(spark, ["a b c", None], n_words=99, n_lines="x", other=1))
    assert out.columns == ["doc_id", "text", "other", *quality_rules.FIGURES] and [r.n_words for r in out.orderBy("doc_id").collect()] == [3, 0]


def test_quality_can_be_filtered_and_takes_other_rules(spark):
    rules = (quality_rules.Rule("long", "n_words", "", None, 100),)
    q = quality_rules.quality_rules(docs(spark, QUALITY), rules=rules)
    assert [r.doc_id for r in q.where("not base_failed and not kept").collect()] == [5]
    assert quality_rules.quality_rules(docs(spark, QUALITY).limit(0)).count() == 0


# Op 2.


def test_quotes_are_cut_and_linked_by_level(spark):
    rows = [
        (1, 0, "user", "Where is it?\nI lost  the KEY."),
        (1, 1, "assistant", "In the car."),
        (1, 2, "user", "On Monday, user wrote:\n> i lost the key.\nNot there."),
        (1, 3, "user", ">> I lost the key.\n> Not there.\nLook again"),
        (1, 4, "assistant", "> never said\nHm"),
        (2, 0, "user", None), (2, 5, "user", ""), (None, 1, "user", "x"), (3, None, "user", "y"), (4, 0, "user", "same"), (4, 0, "user", "same"),
        # Wrapped anew, and an attribution that is none as nothing quoted follows.
        (5, 0, "user", "hello there my friend, how\nare you? All is well.\n\nHe wrote:\nno more"),
        (5, 1, "user", "> hello there\n> my friend, how are\n> you?\n\nFine."),
        (5, 2, "user", "user schrieb am 3. Mai:\n\n> > hello there my friend, how are you?\n> Fine.\nGood\n> All is well.\n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("lines", F.lit(1))
    got = quotation.reply_threads(df).collect()
    assert len(got) == len(rows)
    r = {(x.conv_id, x.turn): x for x in got}
    assert r[1, 2].text == "Not there." and r[1, 2].parent_turn == 0 and r[1, 2].n_linked == 1
    assert r[1, 3].parent_turn == 2 and r[1, 3].quote_depth == 2 and r[1, 3].n_linked == 2 and r[1, 3].text == "Look again"
    assert r[1, 4].parent_turn == 3 and r[1, 4].n_linked == 0 and r[1, 4].n_quoted == 1
    assert r[2, 5].parent_turn is None and r[2, 0].text == "" and r[None, 1].reply_order is None and r[3, None].reply_order is None
    order = [r[1, t].reply_order for t in range(5)]
    assert sorted(order) == [1, 2, 3, 4, 5] and all(r[1, t].parent_turn is None or r[1, r[1, t].parent_turn].reply_order < r[1, t].reply_order for t in range(5))
    assert sorted(x.reply_order for x in got if x.conv_id == 4) == [1, 2]
    assert "He wrote:" in r[5, 0].text and r[5, 1].text == "Fine." and (r[5, 1].n_quoted, r[5, 1].n_linked, r[5, 1].parent_turn) == (1, 1, 0)
    assert (r[5, 2].n_quoted, r[5, 2].n_linked, r[5, 2].parent_turn, r[5, 2].text) == (3, 3, 1, "Good")
    assert quotation.reply_threads(df.limit(0)).count() == 0


def quoting_talks(seed, convs=60):
    """Conversations whose turns quote earlier ones: parts of them, at several levels, wrapped anew, with attributions."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        said, turns = [], int(rng.integers(1, 40 if c else 120))
        for t in range(turns):
            lines = []
            if said and rng.random() < 0.6:
                for _ in range(int(rng.integers(1, 3))):
                    k = int(rng.integers(0, len(said)))
                    part = said[k][int(rng.integers(0, len(said[k]))) :][: int(rng.integers(1, 4))]
                    marks = ">" * int(rng.integers(1, 4))
                    marks = " ".join(marks) if rng.random() < 0.3 else marks
                    if rng.random() < 0.5:
                        lines += [str(rng.choice(["On Tuesday, A B wrote:", "C schrieb am 4. Mai:", "D a écrit :"]))] + [""] * int(rng.integers(0, 2))
                    words = (" " * int(rng.integers(1, 3))).join(part).split(" ")
                    cuts = sorted({0, len(words), *rng.integers(0, len(words) + 1, 2).tolist()})
                    lines += [f"{marks} " + " ".join(words[a:b]).upper() if rng.random() < 0.2 else f"{marks} " + " ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]
                    lines += [""] * int(rng.integers(0, 2))
            own = [" ".join(random_words(rng, int(rng.integers(1, 9)), 400)) + str(rng.choice([".", "?", "!"])) for _ in range(int(rng.integers(1, 5)))]
            said.append(own)
            lines += ["  ".join(own[: len(own) // 2]), "\t".join(own[len(own) // 2 :])]
            rows.append((c, t * (1 + c % 3), "user" if t % 2 else "assistant", "\n".join(lines) if rng.random() < 0.9 else "\r\n".join(lines)))
    return rows + rows[5:8] + [(None, 1, "user", "> a\nb"), (2, None, "user", "> a\nb"), (7, -3, None, None)]


def plain_threads(rows):
    def read(text):
        lines = []
        for x in re.split("\r?\n", text or ""):
            marks = re.match(r"[ \t]*(?:>[ \t]?)*", x)[0]
            level = marks.count(">")
            lines.append([level, x[len(marks) :] if level else x])
        kept, blocks, last = [], [], None
        for i, (level, body) in enumerate(lines):
            after = [x for x in lines[i + 1 : i + 3]]
            deeper = bool(after) and (after[0][0] > level or not after[0][1].strip() and len(after) > 1 and after[1][0] > level)
            by = re.search(r"(?i)(wrote|writes|said|schrieb|a écrit|escribió)[^!?]{0,40}:[ \t]*$", body) and deeper
            if not level and not by:
                kept.append(body)
            if not body.strip() or by:
                last = None
                continue
            if last != level:
                blocks.append([level, []])
            blocks[-1][1].append(body)
            last = level
        found = [(level, s) for level, b in blocks for s in re.sub(r"([.!?]) ", "\\1\x01", " ".join(" ".join(b).lower().split())).split("\x01") if s]
        depth = max(level for level, _ in lines)
        return ("\n".join(kept).strip(" \t\r\n") if depth else text or ""), found, depth

    first = {}
    for c, t, _, x in rows:
        if c is not None and t is not None:
            for level, s in read(x)[1]:
                if not level:
                    first[c, s] = min(t, first.get((c, s), t))
    turns, merged = {(c, t) for c, t, _, _ in rows}, {}
    for c, t, _, x in rows:
        if c is not None and t is not None:
            merged.setdefault((c, t), []).extend((level, first[c, s]) for level, s in read(x)[1] if level and first.get((c, s), t) < t)
    out = []
    for c, t, role, x in rows:
        own, found, depth = read(x)
        links = merged.get((c, t), [])
        votes = Counter(links)
        parent = min(votes, key=lambda v: (v[0], -votes[v], -v[1]))[1] if votes else t - 1 if c is not None and t is not None and (c, t - 1) in turns else None
        out.append([c, t, role, own, sum(level > 0 for level, _ in found), len(links), depth, parent, None])
    low = -(10**9)
    for c in {r[0] for r in out if r[0] is not None}:
        for k, r in enumerate(sorted((r for r in out if r[0] == c and r[1] is not None), key=lambda r: (low if r[7] is None else r[7], r[1], r[2] or "", r[3]))):
            r[8] = k + 1
    return Counter(map(tuple, out))


def test_threads_are_those_of_plain_python_and_of_sql(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    rows = quoting_talks(41)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_threads(rows)
    assert sum(n for r, n in want.items() if r[5]) > 200 and max(r[6] for r in want) >= 3
    for block in (4096, 3):
        monkeypatch.setattr(quotation, "BLOCK", block)
        assert Counter(map(tuple, quotation.reply_threads(df.repartition(4)).collect())) == want
    talks = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", talks)
    got = con.sql(quotation.ORACLE).fetchall()
    assert Counter(got) == want


def test_conversations_are_whole_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(quotation, "MESSAGES", 7)
    threads = quotation.reply_threads(spark.createDataFrame(quoting_talks(42, 6), "conv_id long, turn long, role string, text string"))
    want = {}
    for r in sorted((r for r in threads.collect() if r.reply_order), key=lambda r: (r.conv_id, r.reply_order)):
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {}
    for r in sorted(quotation.conversations(threads).collect(), key=lambda r: (r.conv_id, r.part)):
        assert len(r.messages) <= 7 and r.part == len(got.get(r.conv_id, [])) // 7
        got.setdefault(r.conv_id, []).extend(map(tuple, r.messages))
    assert got == want and not any(">" in x for m in got.values() for _, _, x in m)


# Op 3.


def test_window_fingerprints_are_simhashes_and_none_in_the_radius_is_missed():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**64, 40_000, dtype=np.uint64, endpoint=False)
    p = decontaminate.Probes([])
    sizes = (1, 2, 5, 8, 31, 64, 127, 128, 129, 400)
    for m in sizes:
        # More items than one index holds, of some sizes.
        at = [3, 4090, 16383, 16384, 40_000 - m] + list(range(100, 100 + (90 if m in (8, 129) else 0)))
        p.by[5, m] = decontaminate.Group(m, [(i, h[i : i + m]) for i in at], p.radius // 4)
    got = {(m, int(a), int(b)) for m, at, q in p.candidates(h, 5) for a, b in zip(at, q)}
    for m in sizes:
        f = np.array([decontaminate.simhash(h[i : i + m]) for i in range(len(h) - m + 1)], np.uint64) if m in (5, 129) else decontaminate._long_windows(h, m)
        want = {(m, int(a), b) for b, x in enumerate(p.by[5, m].prints) for a in np.flatnonzero(np.bitwise_count(f ^ x) <= p.radius)}
        assert {x for x in got if x[0] == m} == want


def grams_of(words):
    return Counter(zip(*(words[i:] for i in range(min(5, len(words))))))


def plain_leaks(texts, items):
    """Every window of every document against every item."""
    out = {}
    for i, text in texts.items():
        t = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
        for k, item in items.items():
            w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", item.lower())
            b = grams_of(w)
            for a in range(max(1, len(t) - len(w) + 1)) if t and w else ():
                part = t[a : a + len(w)]
                if len(part) < min(5, len(w)):
                    continue
                g = Counter(zip(*(part[j:] for j in range(min(5, len(w))))))
                s = sum((g & b).values()) / sum((g | b).values())
                if s >= 0.75 and s > out.get((i, k), (0,))[0]:
                    out[i, k] = (s, a)
    return out


def test_leaks_are_those_of_a_search_of_all_windows(spark):
    rng = np.random.default_rng(21)
    items = {k: " ".join(random_words(rng, n, 10**6)) for k, n in enumerate([*rng.integers(5, 60, 25), 150, 150, 300, 3, 80])}
    texts, n = {}, 0
    for k, item in items.items():
        for _ in range(6):
            w = item.split()
            for _ in range(int(rng.integers(0, 1 + max(1, len(w) // 25)))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 10**6)}"
            cut = int(rng.integers(0, 1 + len(w) // 10))
            texts[n] = " ".join(random_words(rng, int(rng.integers(0, 60))) + w[cut:] + random_words(rng, int(rng.integers(0, 60))))
            n += 1
    # Only part of a long item is no leak.
    texts |= {n: " ".join(items[25].split()[:68]), n + 1: None, n + 2: "", n + 3: " ".join(random_words(rng, 3000))}
    want = plain_leaks(texts, items)
    df = docs(spark, texts, similarity=1, item_id=7)
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.find_leaks(df.repartition(3), table).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found}
    assert len(found) == len(got) and set(got) <= set(want) and (n, 25) not in got
    assert len(got) >= 0.99 * len(want) and len(want) > 60 and all(got[x] == want[x] for x in got)
    # Neither repeated rows, nor their places in batches, nor passes change anything.
    twice = df.unionByName(df).repartition(5)
    again = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.find_leaks(twice, table).collect()}
    assert again == got
    assert decontaminate.find_leaks(df.limit(0), table).count() == 0 and decontaminate.decontaminate(df.limit(0), table).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", 2)
    rng = np.random.default_rng(22)
    items = [(k, " ".join(random_words(rng, 20))) for k in range(5)]
    df = docs(spark, {k: t for k, t in items})
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(k, k) for k in range(5)}


def test_leaks_are_found_wherever_they_stand(spark):
    rng = np.random.default_rng(1)
    item = random_words(rng, 40)
    edited = item[:20] + ["other"] + item[21:]
    noise = lambda n: random_words(rng, n)
    texts = {
        1: " ".join(noise(300) + item + noise(50)),
        2: " ".join(item).upper() + "!!",
        3: " ".join(noise(10)) + "\n" + ", ".join(edited),
        4: " ".join(noise(500)),
        5: " ".join(noise(50) + item[:20]),
        6: "one two three", 7: "", 8: None, 9: "say One,  two\nTHREE now", 10: " ".join(noise(30_000) + item),
    }
    items = spark.createDataFrame([(7, " ".join(item)), (8, "one two three"), (9, None), (10, " .. ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs(spark, texts, item_id=3), items).collect()}
    want = {(1, 7), (2, 7), (3, 7), (6, 8), (9, 8), (10, 7)}
    assert set(got) - {(3, 7)} == want - {(3, 7)}
    assert got[1, 7].similarity == 1.0 and got[1, 7].start_word == 300 and got[9, 8].start_word == 1
    kept = decontaminate.decontaminate(docs(spark, texts), items)
    assert {4, 5, 7, 8} <= {r.doc_id for r in kept.collect()} and decontaminate.find_leaks(docs(spark, texts), items.limit(0)).count() == 0


def test_edited_leak_counts_by_weighted_jaccard(spark):
    rng = np.random.default_rng(2)
    item = random_words(rng, 60)
    near = item[:58] + ["x", "y"]
    got = decontaminate.find_leaks(docs(spark, [" ".join(random_words(rng, 20) + near + random_words(rng, 20))]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    grams = lambda w: Counter(zip(*(w[i:] for i in range(5))))
    a, b = grams(item), grams(near)
    want = sum((a & b).values()) / sum((a | b).values())
    assert len(got) == 1 and got[0].similarity >= want - 1e-9


def test_edited_windows_are_found_whatever_their_fingerprints(spark):
    """Recall against brute force: windows at similarity 0.75 to 0.85, each in a document of its own."""
    rng = np.random.default_rng(12)
    grams = lambda w: Counter(zip(*(w[i:] for i in range(5))))
    items, texts, want = [], {}, set()
    for i in range(300):
        # One other word inside: five shingles of 36 to 45.
        item = [f"i{i}x{j}" for j in range(int(rng.integers(40, 50)))]
        near = list(item)
        near[len(item) // 2] = "other"
        a, b = grams(item), grams(near)
        items.append((i, " ".join(item)))
        texts[i] = " ".join(random_words(rng, 20) + near + random_words(rng, 20))
        if 0.75 <= sum((a & b).values()) / sum((a | b).values()) <= 0.85:
            want.add(i)
    got = {r.doc_id for r in decontaminate.find_leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) == 300 and want <= got


def test_documents_shorter_than_an_item_are_compared_whole(spark):
    rng = np.random.default_rng(13)
    item, long = [f"i{j}" for j in range(30)], random_words(rng, 90, 10**6)
    texts = {1: item[:29], 2: item[2:], 3: item[:24], 4: item[:23], 5: item[:14] + ["x"] + item[15:29], 6: long[:60], 7: [], 8: ["one"], 9: item[:29] + item[:1], 10: item[:4]}
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (3, "one two three four")], "item_id long, text string")
    grams = lambda w: Counter(zip(*(w[i:] for i in range(5))))
    want = {}
    for i, t in texts.items():
        for k, other in ((1, item), (2, long)):
            a, b = grams(t), grams(other)
            j = sum((a & b).values()) / sum((a | b).values())
            if j >= 0.75:
                want[i, k] = j
    df = docs(spark, {i: " ".join(t) for i, t in texts.items()})
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, items).collect()}
    assert {k: r.similarity for k, r in got.items()} == want and {(1, 1), (2, 1), (3, 1), (9, 1)} <= set(want) and not {(4, 1), (6, 2)} & set(want)
    assert (got[1, 1].start_word, got[1, 1].n_words) == (0, 29)
    assert {r.doc_id for r in decontaminate.decontaminate(df, items).collect()} == set(texts) - {i for i, _ in want}


# Op 4.


def test_chain_learns_toxic_words_and_leaves_clean_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        w = random_words(rng, 60, 500)
        bad = i % 4 == 0
        if bad:
            w[5], w[20] = ["idiot", "trash"] if i % 8 else ["moron", "pathetic."]
        rows.append((i, " ".join(w), int(bad)))
    rows += [(500, None, 1), (501, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit_chain(df)
    got = by_id(toxicity.score_toxicity(df.withColumn("rejected", F.lit(1)), chain))
    assert all(got[i].rejected == (i % 4 == 0) for i in range(400)) and len(got) == 402
    assert not got[500].rejected and 0 <= got[500].p_toxic <= 1
    assert chain.names == ["kind_1", "kind_2", "kind_3", "toxic"] and [len(b) for b in chain.before] == [0, 1, 2, 3], "each category sees the earlier ones"
    long = toxicity.score_toxicity(docs(spark, ["clean word " * 50_000, "clean word " * 50_000 + "IDIOT! trash", ""]), chain).collect()
    assert [r.rejected for r in sorted(long)] == [False, True, False]


def test_chain_takes_categories_of_the_labels_and_feeds_probabilities(spark):
    rng = np.random.default_rng(31)
    rows = []
    for i in range(600):
        w = random_words(rng, 30, 200)
        rude, threat = i % 5 == 0, i % 7 == 0
        w[:2] = [f"rude{i % 3}" if rude else "x", f"threat{i % 2}" if threat else "y"]
        # Repeated and conflicting labels, and other numbers than 0 and 1.
        rows.append((i, " ".join(w), 2 * int(rude or threat), int(rude), int(threat)))
    rows += [(3, rows[3][1], None, 0, 0), (0, rows[0][1], 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, rude int, threat int")
    chain = toxicity.fit_chain(df, categories=["rude", "threat"])
    got = by_id(toxicity.score_toxicity(df.dropDuplicates(["doc_id"]), chain))
    assert chain.names == ["rude", "threat", "toxic"]
    for i in range(1, 600):
        r = got[i]
        assert (r.p_rude > 0.5, r.p_threat > 0.5, r.rejected) == (i % 5 == 0, i % 7 == 0, i % 5 == 0 or i % 7 == 0)
    # A chain by hand: what the models see of earlier categories are probabilities.
    words, weights = np.array([5], np.uint64), np.array([[2.0], [0.0]])
    p = toxicity.Chain(["a", "b"], words, weights, [np.zeros(0), np.array([3.0])], np.array([-1.0, -1.5])).score(np.array([0]), np.array([0]), 2)
    s = lambda z: 1 / (1 + np.exp(-z))
    assert p == pytest.approx(np.array([[s(1.0), s(3 * s(1.0) - 1.5)], [s(-1.0), s(3 * s(-1.0) - 1.5)]]))
    assert toxicity.score_toxicity(df.limit(0), chain).count() == 0


def test_words_of_a_fold_are_chosen_without_it(spark):
    rows = [(i, ("bad " if i % 3 == 0 else "") + " ".join(random_words(np.random.default_rng(i), 5)), int(i % 3 == 0), i % 4) for i in range(400)]
    # A word that tells labels apart in one fold only.
    rows = [(i, t + (" only" if k == 2 and y else ""), y, k) for i, t, y, k in rows]
    words, chosen = toxicity._telling(spark.createDataFrame(rows, "doc_id long, text string, y int, fold int"))
    bad, only = (int(np.searchsorted(words, next(toxicity._word_hashes([w]))[3][0])) for w in ("bad", "only"))
    assert chosen[:, bad].all() and chosen[:, only].tolist() == [True, True, False, True, True]


def test_held_out_toxic_documents_are_found(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.col("doc_id") % 4 == 1
    chain = toxicity.toxic_chain(d, labels.where(~held))
    got = toxicity.score_toxicity(d, chain).join(labels.where(held), "doc_id").toPandas()
    assert got["rejected"][got["toxic"] == 1].mean() >= 0.8 and (~got["rejected"][got["toxic"] == 0]).mean() >= 0.99 and len(got) > 800


def plain_hash(bytes_, extra=0):
    """The hash of a word's bytes, or of its beginning, with whole numbers."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(bytes_)) & mask ^ extra
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * factor & mask
    return h ^ h >> 33


def test_scores_are_those_of_plain_python(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    d = d.unionByName(docs(spark, {10**6: "", 10**6 + 1: "x " * 700_000 + "TRASH idiot scum clown", 10**6 + 2: None}), allowMissingColumns=True)
    chain = toxicity.toxic_chain(d, labels)
    place = {int(h): k for k, h in enumerate(chain.words)}
    assert len(place) > 3
    for r in toxicity.score_toxicity(d, chain).join(d.select("doc_id", "text"), "doc_id").collect():
        words = {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").lower())}
        n = toxicity.BEGINNING
        held = {place[h] for w in words for h in (plain_hash(w), plain_hash(w[:n], n)) if h in place}
        p = []
        for c in range(len(chain.names)):
            p.append(1 / (1 + np.exp(-(chain.bias[c] + sum(chain.weights[c][k] for k in held) + sum(a * b for a, b in zip(p, chain.before[c]))))))
        assert [r[f"p_{x}"] for x in chain.names] == pytest.approx(p) and r.rejected == (p[-1] >= 0.5)


def test_chain_without_labels_says_the_base_rate(spark):
    df = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert [r.rejected for r in toxicity.score_toxicity(docs(spark, ["a"]), toxicity.fit_chain(df), threshold=0.9).collect()] == [False]


# Op 5.


def test_codes_are_far_apart():
    for k in (2, 3, 4, 5, 9):
        m = language_id.code_matrix(k)
        assert all((a != b).sum() >= 1 for a, b in itertools.combinations(m, 2)) and m.shape[0] == k
        assert k < 4 or min((a != b).sum() for a, b in itertools.combinations(m, 2)) >= 3


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    from arclet.llm.queries import op5_language_id

    got = op5_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(language_id.is_held_out)).all()
    out = got[got["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() >= 0.9 and got["score"].between(0, 1).all()


def test_every_language_with_a_text_is_learned(spark, monkeypatch):
    rows = [(i, "xx", None if i % 200 else "zyx wvu tsr " * 5) for i in range(2000)] + [(30_000 + i, "en", f"the cat sat on mats {i}") for i in range(700)]
    rows += [(None, "yy", "qq rr ss"), (None, "yy", None), (5, "zz", "123 ?!"), (6, None, "text"), (7, "one", "\u00e9t\u00e9")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert language_id.fit_codes(df).langs == ["en", "one", "xx", "yy"]
    for bound, langs in ((60, ["en", "one", "xx", "yy"]), (4, ["en", "one", "xx", "yy"]), (2, ["en", "one"])):
        monkeypatch.setattr(language_id, "TRAIN_ROWS", bound)
        assert language_id.fit_codes(df).langs == langs


def test_languages_are_decoded_as_plain_python_does(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    codes = language_id.fit_codes(d)
    texts = {r.doc_id: r.text for r in d.limit(40).collect()} | {-1: "\u00dcber den FLUSS \u00e9", -2: "a", -3: "ab " * 3000}
    # Several strips for the longer ones, which must count no n-gram twice and lose none.
    monkeypatch.setattr(language_id, "STRIP", 1000)
    mask = (1 << 32) - 1
    for i, text in texts.items():
        b = f" {text.lower()} ".encode()
        counts = Counter()
        for n in (2, 3):
            for k in range(len(b) - n + 1):
                h = sum(x * m for x, m in zip(b[k : k + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) & mask
                h = (h ^ h >> 15) * 0x27D4EB2F & mask
                counts[h >> 20] += 1
        assert language_id.ngram_counts(text).tolist() == [counts[k] for k in range(language_id.BUCKETS)]
        if i % 4 == 0:
            x = [(counts[k] / sum(counts.values())) ** 0.5 for k in range(language_id.BUCKETS)]
            odds = [sum(w * f for w, f in zip(row, x)) + b0 for row, b0 in zip(codes.weights, codes.bias)]
            loss = [sum(t * np.log1p(np.exp(-m * o)) for m, o, t in zip(word, odds, codes.trust)) for word in codes.matrix]
            names, share, _ = codes.decode(language_id.features(text)[None])
            assert names[0] == codes.langs[int(np.argmin(loss))] and share[0] == pytest.approx(np.exp(-min(loss)) / sum(np.exp(-v) for v in loss))
    # Equal codewords are equally near: the first by name is taken.
    same = language_id.Codes(["a", "b"], np.ones((2, 1)), np.zeros((1, language_id.BUCKETS)), np.zeros(1), np.ones(1))
    assert same.decode(np.zeros((1, language_id.BUCKETS)))[0] == ["a"]


def test_language_of_odd_texts(spark):
    codes = language_id.fit_codes(spark.createDataFrame([(i, "der die das und", "de") if i % 2 else (i, "the of and is", "en") for i in range(20)], "doc_id long, text string, lang string"))
    got = by_id(language_id.predict_language(docs(spark, [None, "", "123 !?", "das und die " * 40_000, "the and of"]), codes))
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "de", "en"] and got[0].score == 0.0
    assert language_id.predict_language(docs(spark, ["text"]).limit(0), codes).count() == 0
    twice = language_id.predict_language(docs(spark, ["the of", "the of"], lang_pred="clash", score=2).unionByName(docs(spark, ["the of"], lang_pred="x", score=1)), codes).collect()
    assert [r.lang_pred for r in twice] == ["en"] * 3
    none = language_id.fit_codes(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_id.predict_language(docs(spark, ["text"]), none).first().lang_pred == "und"


# Op 6.


def test_main_text_of_pages():
    tree = html_text.train_tree()
    p = " ".join(f"word{i}" for i in range(30))
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script><style>p{{}}</style></head>
      <body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">{p} cookies</div>
      <article><h2>Head&amp;line</h2><p>{p} a &lt; b&nbsp;c<p><b>unclosed {p}</p><ul><li>item &eacute;</li></ul><aside>{p} aside</aside><form>{p}<input></form>
      <!-- <p>hidden</p> --><blockquote>Quote</blockquote></article><section id="comments"><p>{p} comment</p></section><div class="ad">{p}</div><footer>{p}</footer></body></html>"""
    assert html_text.main_text(page, tree) == f"Head&line {p} a < b c unclosed {p} item é Quote"
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<nav>x</nav>", tree) == ""
    assert html_text.main_text(f"<p>{p}</p><div>{p} more</div><p>{p} <a hre", tree) == f"{p} {p} more {p}"
    assert html_text.main_text("<article>" + f"<p>{p}</p>" * 3000, tree).count("word0") == 3000


def test_what_follows_drawings_and_long_names_is_read():
    tree = html_text.train_tree()
    many = lambda w: f"<p>{' '.join([w] * 30)}</p>"
    read = lambda page: {w for w in html_text.main_text(page, tree).split()}
    for svg in ("<svg/>", "<math />", '<svg width="1"/>', "<svg width=1/>gone</svg>", "<svg>gone</svg>"):
        assert read(f"<article>{many('one')}{svg}{many('tail')}</article>") == {"one", "tail"}, svg
    # A script ends where it says so, whatever its own slash.
    assert read(f"<article>{many('one')}<script/>gone</script>{many('tail')}</article>") == {"one", "tail"}
    for n in (0, 150, 250, 3000):
        assert read(f"<div class='{'x' * n} sidebar'>{many('gone')}</div><div>{many('kept')}</div>") == {"kept"}
    # An item in an inner list is none of the outer item's end, and a paragraph ends one that has much open in it.
    states = html_text.blocks("<div class=sidebar><ul><li>a<ul><li>b<li>c</ul><li>d</ul>e</div><p><b><i><u><em>f<p>g")
    assert [(b.text, b.state.item, b.state.name) for b in states] == [("a", True, -1), ("b", True, -1), ("c", True, -1), ("d", True, -1), ("e", False, -1), ("f", False, 0), ("g", False, 0)]


def test_tree_splits_on_words_links_and_neighbours():
    report = html_text.train_tree().report()
    assert {"words", "link_density", "words_before", "links_before", "words_after", "links_after"} <= set(report)
    # The words above a list of links go with it, the same words above text stay.
    few, many = "<h3>few words</h3>", f"<p>{'many ' * 30}</p>"
    read = lambda page: html_text.main_text(page, html_text.train_tree())
    assert "few words" not in read(f"<article>{many}{few}<p><a>some other page</a></p><p><a>another</a></p>{many}</article>")
    assert "few words" in read(f"<article>{many}{few}{many}</article>")
    table = html_text.labelled_blocks()
    assert all(html_text.classify(html_text.train_tree(table), f) == bool(y) for f, y in table)


#: Labelled as the training pages are; none of them is one of those.
UNSEEN = (
    "<div class=top><a>{1}</a><a>{2}</a></div><h1 y>{7}</h1><div y>{30}</div><div y>{3}</div><div y>{50}</div><div><a>{4}</a> <a>{2}</a></div>",
    "<nav>{3}</nav><main y><p>{13}</p><p>{2} <a>{1}</a></p><h3>{2}</h3><p>{90}</p></main><footer><p>{40}</p></footer>",
    "<div class=navbar><a>{2}</a></div><article y class='post share-enabled'><p>{22}</p><p>{1}</p><table><tr><td>{2}<td>{3}</tr></table></article><div class=related><p>{9}</p></div>",
    "<body class=no-sidebar><p y>{33}</p><p y>{28}</p><p y>{17}</p><p><a>{3}</a></p>",
    "<div class='page has-banner'><article y><p>{18}</p><p>{4}</p></article></div><div class=disqus><p>{60}</p></div>",
    "<form><div><a>{1}</a></div><article y><h1>{4}</h1><p>{15}</p><p>{5}</p></article></form>",
    "<form><p y>{31}</p><p y>{44}</p><p y>{26}</p></form>",
    "<div class=cookieNotice>{30}</div><section y class=entry><p>{3}</p><p>{41}</p><form y=0><p>{20}</p></form></section><div id=sidebar>{30}</div>",
    "<p><a>{5}</a></p><p><a>{6}</a></p><p y>{60}</p><p y>{45}</p><p>{1} <a>{2}</a></p>",
    "<article y><p>{3}</p><div y=0 class=ad>{14}</div><p>{6}</p></article><aside>{50}</aside>",
)


def test_blocks_of_unseen_pages():
    tree = html_text.train_tree()
    table = html_text.labelled_blocks(UNSEEN)
    right = sum(html_text.classify(tree, f) == bool(y) for f, y in table)
    assert len(table) > 40 and right / len(table) >= 0.95


def test_articles_of_all_pages(spark):
    """Held out: no test page is a training page."""
    from arclet.llm.queries import op6_html_extraction

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op6_html_extraction(spark, SF).collect()}
    for i, page in pages.items():
        inner = page[page.index("<article>") + 9 : page.rindex("</article>")]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1|br|blockquote|ul|li|div)\b[^>]*>", inner)]
        assert got[i] == " ".join(x for x in (" ".join(x.split()) for x in parts) if x)


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 150_000 + "</i>" * 150_000, '<a "' * 250_000 + ">", "<" * 10**6, "<script>" * 120_000, "<div class=x>" * 70_000, "<!--" * 250_000, "<p>x" * 250_000, "<title></titl" * 80_000, "&" * 10**6])
def test_hostile_pages_take_linear_time(page):
    tree = html_text.train_tree()
    half = time.process_time()
    html_text.main_text(page[: len(page) // 4], tree)
    half = time.process_time() - half
    whole = time.process_time()
    html_text.main_text(page, tree)
    assert time.process_time() - whole < max(2.0, 9 * half)


def test_pages_keep_a_row_each(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>"), (2, None, None), (1, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect()) == [(1, "", 0), (1, "é", 1), (2, "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0
    none = html_text.extract_text(spark.createDataFrame([(None, None, "<article>a</article>")], "page_id long, url string, html string")).first()
    assert (none.page_id, none.url, none.text) == (None, None, "a")


# Op 7.


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words_of("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {i: i for i in texts}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts, n = {0: "", 1: None, 2: " \n ", 3: "a b", 4: "A  b", 5: "a b c", 6: "É x", 7: "é x"}, 8
    shared = random_words(rng, 12)
    for _ in range(12):
        base = random_words(rng, int(rng.integers(8, 120)))
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + len(w) // 25 + 1))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 10**6)}"
            texts[n] = " ".join(w + (shared if rng.random() < 0.3 else []))
            n += 1
    for i in range(60):
        texts[n + i] = " ".join(shared + random_words(rng, int(rng.integers(1, 9))))
    want = plain_components(texts)
    got = by_id(ngram_join.jaccard_components(docs(spark, texts, node=1, n=2).repartition(3)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_sets_of_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "mixed", lambda h: h & np.uint64(3))
    rng = np.random.default_rng(51)
    base = [random_words(rng, 12) for _ in range(12)]
    texts = {i: " ".join(base[i % 12]) for i in range(30)}
    monkeypatch.setattr(ngram_join, "digest_of", lambda s: int(np.bitwise_xor.reduce(s).view(np.int64)))
    assert len({ngram_join.node_of(s) for s in shingle_sets(texts.values())}) <= 4
    # Workers import the module anew, so what they run is run here.
    def here(df, f, schema):
        return df.sparkSession.createDataFrame(pd.concat([x for x in f(iter([df.toPandas()]))] or [pd.DataFrame()], ignore_index=True), schema)

    seen = here(docs(spark, texts), ngram_join._sets(5), "kind byte, doc_id long, n long, node long, second long, sketch binary").where("kind = 0").collect()
    twins = {r.node for r in seen if len({x.second for x in seen if x.node == r.node}) > 1}
    names = {i: ngram_join.node_of(s, frozenset(twins)) for i, s in zip(texts, shingle_sets(texts.values()))}
    assert twins and len(set(names.values())) == 12 and all((names[a] == names[b]) == (a % 12 == b % 12) for a in texts for b in texts)


def test_chunks_of_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_CHUNK", 7)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = np.random.default_rng(5)
    base = random_words(rng, 60)
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(4):
            w[int(rng.integers(0, 60))] = f"e{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    got = by_id(ngram_join.jaccard_components(docs(spark, texts)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == plain_components(texts)


def test_sketches_bound_differences():
    rng = np.random.default_rng(6)
    for n, m in ((5, 5), (100, 130), (1000, 10)):
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        a, b = np.r_[both, rng.integers(0, 2**64, m, dtype=np.uint64)], both
        assert ngram_join.sketch_distance(ngram_join.sketch(a), ngram_join.sketch(b)) <= m
    assert [len(s) for s in shingle_sets(["a b c d e f", "a", "", None, "a a a a a a a"])] == [2, 1, 0, 0, 1]


def test_join_of_empty_table_and_repeated_rows(spark):
    assert ngram_join.jaccard_components(docs(spark, {}).limit(0)).count() == 0
    twice = docs(spark, ["a b c d e f"]).unionByName(docs(spark, ["a b c d e f"])).unionByName(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.component_id) for r in ngram_join.jaccard_components(twice).collect()) == [(False, 0), (False, 0), (True, 0)]


# Op 8.


def test_pieces_are_those_of_the_tokenizer_and_bins_are_gapless(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(7)
    texts = {i: " ".join(random_words(rng, int(rng.integers(1, 900)))) for i in range(60)} | {60: None, 61: "", 62: "word " * 9000, 63: "Don't  stop now\n\té", 64: "x" * 20_000}
    got = packing.pack_documents(docs(spark, texts, offset=1), tokenizer_path()).toPandas()
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == i].sort_values("piece")
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(struct.pack(f"<{len(ids[a:a + 4096])}I", *ids[a : a + 4096]))) for k, a in enumerate(range(0, len(ids), 4096))]
        assert list(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_tree_of_rounds_packs_as_well(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 3000, 500)
    pieces = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing.PIECES)
    got = packing.pack(pieces, partitions=9).toPandas()
    assert len(got) == 500 and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= 1.06 * sizes.sum() / 4096 + 2
    assert packing.pack(pieces.limit(0)).count() == 0
    odd = packing.pack(spark.createDataFrame([(None, 0, 0, 5, 1), (3, 0, 0, 4096, 1)], packing.PIECES)).collect()
    assert len(odd) == 2


@pytest.mark.parametrize("low,high,n", [(2100, 3900, 20_000), (1, 700, 8000), (1500, 2500, 6000)])
def test_few_bins_go_on_and_packing_stays_near_the_bound(spark, low, high, n, monkeypatch):
    rng = np.random.default_rng(23)
    sizes = rng.integers(low, high, n)
    seen = []
    inner = packing.stored
    monkeypatch.setattr(packing, "stored", lambda df: (out := inner(df), "full" in out.columns and seen.append((out.where("not full").count(), out.rdd.getNumPartitions())))[0])
    pieces = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "piece": np.int32(0), "start": np.int64(0), "length": sizes.astype(np.int64), "ids_crc32": np.int64(0)}), packing.PIECES)
    got = packing.pack(pieces, partitions=16).toPandas()
    assert len(got) == n and got.groupby("sequence_id").length.sum().max() <= 4096
    assert [m for m, _ in seen][-1] == 0 and all(m <= p * 5 for (m, _), p in zip(seen, (16, 4, 1)))
    # What one task would make of all.
    alone = len(packing.best_fit(sizes.tolist(), 4096))
    assert got.sequence_id.nunique() <= alone * 1.005 + 2


def test_literal_special_tokens_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    words = packing.WordIds(tokenizer_path())
    for t in ("a b <|endoftext|> c", "<|startoftext|>a b<|endoftext|>. <|ENDOFTEXT|> <|endoftext|><|endoftext|> <| |> endoftext|>", "it's<|endoftext|>'s"):
        w = words.words(t)
        words.learn([w])
        assert words.of(w) == packing._packed(tok.encode(t, add_special_tokens=False).ids), t


def test_rows_of_null_and_repeated_ids_are_all_packed(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(14)
    rows = [(i, " ".join(random_words(rng, n))) for i, n in [(None, 3000), (None, 50), (None, 7), (5, 3000), (5, 20), (5, 20), (-1, 9), (6, 30), (1 << 60, 3)]] + [(6, "same"), (6, "same")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path()).toPandas()
    want = []
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        want += [(-7 if i is None else i, k, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))) for k, own in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))]
    have = [(-7 if r.doc_id is None else r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.astype(object).where(got.notna(), None).itertuples()]
    assert sorted(have) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 4096


@pytest.mark.parametrize("sizes", [[], [5], [4, 4, 4], [3, 3, 2, 2, 5, 5]])
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 5)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 5 for b in bins)


# Op 9.


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/%0A", "same é"), (1, None, "same é"), (2, "u", ""), (9, "v", None), (4, "w", "one\r\n\r\nWARC/1.1\r\n"), (4, "w", "one\r\n\r\nWARC/1.1\r\n"), (-5, "x\ny", "z" * 200_000),
            (None, "q", "no id"), (None, "q2", "same é"), (None, None, "twice"), (None, None, "twice"), (7, "r", "other"), (7, "r", "another")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("row", F.lit(1)).repartition(4)
    got = warc.round_trip(df, str(tmp_path / "a")).collect()
    low = {}
    for page, _, h in rows:
        low[h or ""] = min([x for x in (low.get(h or ""), page) if x is not None], default=None)
    want = []
    for page, url, h in rows:
        payload = (h or "").encode()
        want.append((page, url, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()))
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got) == Counter(want)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (9, "revisit", 2), (4, "response", None), (4, "revisit", 4), (-5, "response", None),
                             (None, "response", None), (None, "response", None), (None, "revisit", None), (7, "response", None), (7, "response", None)])
    payloads = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert payloads.count() == len({h or "" for _, _, h in rows}), "each payload once"
    records = warc.records(spark, str(tmp_path / "a")).collect()
    ids = [warc.parse_record(bytes(r.record))[0]["WARC-Record-ID"] for r in records]
    assert len(set(ids)) == len(rows)
    record = next(bytes(r.record) for r in records if r.page_id == 4 and b"WARC-Type: response" in bytes(r.record))
    assert warc.parse_record(record)[2] == rows[4][2].encode()
    small = [(r.page_id, r.record_type) for r in warc.round_trip(df, str(tmp_path / "b"), least_bytes=1).collect()]
    assert (9, "response") in small and (3, "revisit") in small
    with pytest.raises(ValueError):
        warc.parse_record(record[:-1])


def test_archive_files_hold_the_records(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3} é</p>" * 50) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archive(df, str(tmp_path / "a"))
    files = warc.export_warc(spark, str(tmp_path / "a"), str(tmp_path / "out"))
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    found = []
    while whole:
        head = whole[: whole.index(b"\r\n\r\n") + 4]
        size = len(head) + int(re.search(rb"Content-Length: (\d+)\r\n\r\n$", head)[1]) + 4
        found.append(warc.parse_record(whole[:size]))
        whole = whole[size:]
    assert sum(f["WARC-Type"] == "warcinfo" for f, _, _ in found) == len(files) == 1
    full = {f["WARC-Record-ID"]: p for f, _, p in found if f["WARC-Type"] == "response"}
    got = {f["WARC-Target-URI"]: full[f.get("WARC-Refers-To", f["WARC-Record-ID"])].decode() for f, _, _ in found if f["WARC-Type"] != "warcinfo"}
    assert got == {u: h for _, u, h in rows} and len(full) == 3


def test_addresses_are_written_as_they_are(spark, tmp_path):
    rows = [(0, "http://a/x%20y?q=%C3%A9", "p"), (1, "http://a/\u00e9 z", "q"), (2, "a\r\nWARC-Type: resource\nb", "r"), (3, "", "s"), (4, None, "t"), (5, "http://b/%0A", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"), date="2024-05-06T07:08:09Z")
    got = {r.page_id: warc.parse_record(bytes(r.record))[0] for r in warc.records(spark, str(tmp_path / "a")).collect()}
    uris = [got[i].get("WARC-Target-URI") for i in range(6)]
    assert uris == ["http://a/x%20y?q=%C3%A9", "http://a/\u00e9 z", "a%0D%0AWARC-Type: resource%0Ab", "", None, "http://b/%0A"]
    assert {f["WARC-Date"] for f in got.values()} == {"2024-05-06T07:08:09Z"}
    assert sorted((r.page_id, r.url) for r in warc.read_archive(spark, str(tmp_path / "a")).collect()) == [(i, u) for i, u, _ in rows]
    # Another payload under a record is found out, for those that revisit it too.
    spark.read.parquet(str(tmp_path / "a" / "payloads")).withColumn("payload", F.lit(b"other")).write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "headers")).where("not kept").write.parquet(str(tmp_path / "b" / "headers"))
    with pytest.raises(Exception, match="is not that of its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, str(tmp_path / "e")).count() == 0


# Op 10.


def plain_lines(text):
    return [x for x in re.split(r"(?<=\n)|(?<=[.!?,;:] )", text) if x]


def chained(numbers):
    """The hash of longs in a row, by the public xxHash."""
    seed = 42
    for x in numbers:
        seed = xxhash.xxh64(struct.pack("<q", x), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plain_dedup(texts, run_words=None):
    """Boundaries, places and removal in plain Python; chunks are known by their bytes. Ids as keys."""
    lines = {i: plain_lines(t) for i, t in texts.items() if t is not None}
    bare = {i: [x.strip(" \t\r\n") for x in own] for i, own in lines.items()}
    found, spans = {}, {}
    for i in sorted(lines):
        one = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in bare[i]]
        one = [x - (1 << 64) if x >> 63 else x for x in one]
        roll = [chained(one[max(0, k - 1) : k + 1]) if k else one[0] for k in range(len(one))]
        starts = [k for k in range(len(roll)) if k == 0 or k + 1 < len(roll) and roll[k] < roll[k - 1] and roll[k] < roll[k + 1]]
        spans[i] = [(a, b) for a, b in zip(starts, [*starts[1:], len(roll)]) if b - a > 1]
        for a, b in {*spans[i], *((k, k + 2) for k in range(len(roll) - 1) if run_words)}:
            found.setdefault(tuple(bare[i][a:b]), []).append((i, a, b))
    gone = {place for places in found.values() for place in sorted(places)[1:]}
    out = {i: None for i in texts}
    for i, own in lines.items():
        cut = {k for a, b in spans[i] if (i, a, b) in gone for k in range(a, b)}
        k = 0
        while run_words and k + 1 < len(own):
            e = k
            while (i, e, e + 2) in gone:
                e += 1
            if e > k and len(words_of("".join(own[k : e + 1]))) >= run_words:
                cut.update(range(k, e + 1))
            k = max(e, k + 1)
        out[i] = "".join(x for k, x in enumerate(own) if k not in cut), len(cut)
    return out


def sentences(rng, n):
    return [" ".join(random_words(rng, int(rng.integers(3, 9)))) + "." for _ in range(n)]


def test_removal_is_that_of_plain_python(spark):
    rng = np.random.default_rng(9)
    passage, junk = sentences(rng, 30), ["The The. "] * 40
    texts = {i: " ".join(sentences(rng, 10)) + " tail " + " ".join(passage) + " " + "\n".join(sentences(rng, 5)) for i in range(5)}
    texts |= {5: None, 6: "", 7: "\n\n \n", 8: " ".join(passage), 9: "one, two. three\x01 four. " * 400, 10: "only one line", 11: "".join(junk), 12: " ".join(sentences(rng, 4)) + " " + "".join(junk)}
    for i in range(13, 60):
        parts = [sentences(rng, int(rng.integers(1, 12))), passage[int(rng.integers(0, 20)) :][: int(rng.integers(2, 14))], sentences(rng, 3), junk[: int(rng.integers(0, 5))]]
        texts[i] = " ".join(x for k in rng.permutation(4) for x in parts[k])
    df = docs(spark, texts, n_removed_lines=9, hash="clash", cs=1, id=2, row=3, text_="x").repartition(5)
    for words in (None, 50, 12):
        got = by_id(line_chunks.dedup_lines(df, run_words=words, ends=line_chunks.CLAUSES))
        assert {i: None if r.text is None else (r.text, r.n_removed_lines) for i, r in got.items()} == plain_dedup(texts, words)
    assert got[0].n_removed_lines == 0 and all(got[i].n_removed_lines >= 20 for i in (1, 2, 3, 4, 8))
    assert got[5].text is None and got[10].text == "only one line" and (got[0].hash, got[0].cs, got[0].id, got[0].row, got[0].text_) == ("clash", 1, 2, 3, "x")


def test_columns_of_any_name_come_through(spark):
    texts = ["one line here\ntwo lines here\nthree lines here\n" * k for k in (1, 1, 2)]
    rows = docs(spark, texts, _=1, c=2, c0="x", cs=3, place="p", row=4, id=5, hash=6, n_removed_lines=9)
    out = line_chunks.dedup_lines(rows)
    assert [c for c in out.columns if not c.startswith("n_removed")] == [c for c in rows.columns if c != "n_removed_lines"]
    for r in out.collect():
        assert (r["_"], r["c"], r["c0"], r["cs"], r["place"], r["row"], r["id"], r["hash"]) == (1, 2, "x", 3, "p", 4, 5, 6)
    assert sum(r.n_removed_lines for r in out.collect()) > 0


def test_lines_end_at_line_breaks_unless_told_else(spark):
    a, b = "one two. three\nfour, five\n", "zero. \n"
    got = by_id(line_chunks.dedup_lines(docs(spark, [a + "x\ny", b + "one two. three", a, "four, five. one two. three"])))
    assert got[2].text == "" and got[2].n_removed_lines == 2 and got[3].n_removed_lines == 0 and got[1].n_removed_lines == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    rng = np.random.default_rng(16)
    p, q = sentences(rng, 20), sentences(rng, 20)
    rows = [(1, " ".join(p)), (2, " ".join(q)), (3, " ".join(sentences(rng, 6) + p)), (3, " ".join(q)), (3, " ".join(q)), (None, " ".join(p)), (None, None), (4, None), (4, " ".join(q))]
    got = line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), run_words=50, ends=line_chunks.CLAUSES).collect()
    assert sorted((r.doc_id or 0, r.n_removed_lines > 10, r.text is None) for r in got) == [(0, False, False), (0, False, True), (1, False, False), (2, False, False), (3, True, False), (3, True, False), (3, True, False), (4, False, True), (4, True, False)]


def test_every_repeated_run_of_fifty_words_goes(spark):
    rng = np.random.default_rng(15)
    clause = lambda n: " ".join(random_words(rng, n, 10**6))
    texts, runs, short = {}, {}, {}
    for k in range(60):
        n = 2 if k < 10 else int(rng.integers(3, 12))
        size = -(-int(rng.integers(51, 81)) // n)
        passage = [clause(size) + str(rng.choice([".", ",", "?"])) for _ in range(n)]
        one = [f"only {clause(10)}.", f"two {clause(10)}."]
        for d in (2 * k, 2 * k + 1):
            texts[d] = "\n".join([" ".join(sentences(rng, 12)), " ".join(passage), " ".join(sentences(rng, 12)), " ".join(one), " ".join(sentences(rng, 9))])
        runs[k], short[k] = passage, one
    # A pair that stands in an earlier text too breaks no run; a run that repeats in one text goes as well.
    texts[-1] = " ".join(runs[20][:2]) + " " + clause(5)
    texts |= {200: " ".join(runs[30]) + "\n" + clause(5) + ".\n" + " ".join(runs[30]), 201: clause(80), 202: clause(80), 203: None, 204: "", 205: "a. " * 300}
    texts[202] = texts[201]
    got = by_id(line_chunks.dedup_lines(docs(spark, texts), run_words=50, ends=line_chunks.CLAUSES))
    base = by_id(line_chunks.dedup_lines(docs(spark, texts), ends=line_chunks.CLAUSES))
    for k, passage in runs.items():
        assert all(x in got[2 * k].text for x in passage[2:]) and not any(x in got[2 * k + 1].text for x in passage), k
        assert got[2 * k + 1].text.count(" ") <= base[2 * k + 1].text.count(" ")
    assert any(x in base[2 * k + 1].text for k, p in runs.items() for x in p), "chunks alone leave some"
    assert any(x in got[2 * k + 1].text for k, p in short.items() for x in p) and not any(x in got[200].text for x in runs[30])
    assert got[202].text == texts[202] and got[203].text is None and got[204].text == "" and got[205].text.count("a.") == 1
    # No line is lost: each still stands somewhere.
    left = {x.strip() for r in got.values() for x in plain_lines(r.text or "")}
    assert {x.strip() for t in texts.values() for x in plain_lines(t or "")} <= left | {""}


def test_equal_hashes_of_other_bytes_are_told_apart(spark, monkeypatch):
    """Hashes are made to collide: bytes must decide."""
    texts = {0: "aa. bb. cc. dd.", 1: "ee. ff. gg. hh.", 2: "aa. bb. cc. dd.", 3: "ee. ff. gg. hh. " * 2, 4: "xx. yy. zz. uu."}
    want = plain_dedup(texts, 2)
    assert by_id(line_chunks.dedup_lines(docs(spark, texts), run_words=2, ends=line_chunks.CLAUSES))[3].text == want[3][0]
    monkeypatch.setattr(line_chunks, "_digests", lambda lines: F.transform(lines, lambda x: F.crc32(line_chunks._bare(x).cast("binary"))))
    monkeypatch.setattr(line_chunks, "_digest", lambda own, place: F.crc32(F.slice(own, line_chunks._start(place) + 1, line_chunks._n_lines(place)).cast("string").cast("binary")))
    monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *c: F.length(F.concat_ws("", *[x.cast("string") for x in c if not isinstance(x, str)])).cast("long") if all(not isinstance(x, str) for x in c) else F.lit(1).cast("long"))
    for words in (None, 2):
        got = by_id(line_chunks.dedup_lines(docs(spark, texts), run_words=words, ends=line_chunks.CLAUSES))
        assert [got[i].text for i in (0, 1, 4)] == [texts[i] for i in (0, 1, 4)]
    assert got[2].text == "" and got[3].text == ""


def test_rows_of_one_document_keep_their_text(spark):
    t = " ".join(sentences(np.random.default_rng(11), 20))
    twice = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text == t) for r in line_chunks.dedup_lines(twice, ends=line_chunks.CLAUSES).collect())
    assert got[:3] == [(0, True), (1, True), (1, True)] and got[3] == (2, False)
    assert line_chunks.dedup_lines(twice.limit(0)).count() == 0
