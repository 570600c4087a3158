"""Groups of near copies whose lists begin with smaller sets that are near none of them."""

import itertools

import numpy as np
import pandas as pd
from test_text_ops import by_id, docs, plain_components, random_words

from arclet.llm import ngram_join


def with_decoys(rng, m, edits):
    """m copies of a text of 400 words, each with as many words changed as one of edits, and texts of most of either half."""
    base = [f"b{i}" for i in rng.permutation(400)]
    texts = {0: " ".join(base[:250] + random_words(rng, 30)), 1: " ".join(base[150:] + random_words(rng, 30))}
    for i in range(2, m + 2):
        w = list(base)
        for at in rng.integers(0, 400, int(rng.choice(edits))):
            w[at] = f"e{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    return texts


def test_links_of_near_copies_grow_as_the_group(spark):
    m = 80
    texts = with_decoys(np.random.default_rng(7), m, [2])
    _, links = ngram_join.jaccard_links(docs(spark, texts))
    assert links.count() <= 10 * m
    got = by_id(ngram_join.jaccard_components(docs(spark, texts)))
    assert {r.component_id for i, r in got.items() if i > 1} == {2} and {got[i].component_id for i in (0, 1)} == {0, 1}


def test_copies_near_the_threshold_lose_no_link(spark):
    rng, texts = np.random.default_rng(8), {}
    for _ in range(3):
        n = len(texts)
        texts |= {n + i: t for i, t in with_decoys(rng, 30, [5, 7, 8, 9]).items()}
        texts = {i: t if i < n else t.replace("b", f"b{n}x") for i, t in texts.items()}
    want = plain_components(texts)
    assert 20 < len({c for _, c in want.values()}) < 90
    got = by_id(ngram_join.jaccard_components(docs(spark, texts).repartition(3)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_forest_reaches_what_all_pairs_reach():
    rng = np.random.default_rng(9)
    for k in (2, 9, 40):
        label = rng.integers(0, k, 60)
        pairs = np.array([p for p in itertools.combinations(range(60), 2) if label[p[0]] != label[p[1]] and rng.random() < 2 / k], np.int64).reshape(-1, 2)
        far = rng.integers(0, 6, len(pairs)) / 6
        tree = ngram_join.spanning(label, pairs[:, 0], pairs[:, 1], far)
        low = {x: x for x in label}

        def find(x):
            while low[x] != x:
                x = low[x]
            return x

        costs = []
        for e in np.argsort(far, kind="stable"):
            a, b = find(label[pairs[e, 0]]), find(label[pairs[e, 1]])
            if a != b:
                low[a] = b
                costs.append(far[e])
        assert sorted(far[tree]) == costs and len(set(tree)) == len(tree)


def test_lists_hand_on_forests_and_then_each_pair_once():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.sort(np.r_[base[rng.random(300) > 0.03], rng.integers(0, 2**63, 5, dtype=np.uint64)]) for _ in range(40)]
    rows = []
    for token in range(1, 7):
        for i, s in enumerate(sets):
            before = np.array([token - x if token > x else 0 for x in range(1, ngram_join.BEFORE + 1)], np.int64)
            rows.append((token, 0, 0, i, len(s), token - 1, 0.0, 1.0, i, 0, ngram_join.sketch(s), before))
    pdf = pd.DataFrame(rows, columns="token lo hi node n pos least most label chunk sketch before".split()).sort_values(["token", "n", "node"])
    run = lambda forest, frame: pd.concat(ngram_join._crossing(75, forest)(iter([frame[:100], frame[100:]])), ignore_index=True)
    forest, every = run(True, pdf.assign(before=None)), run(False, pdf)
    assert forest.more.all() and (forest.groupby("token").size() == 39).all() and sorted(set(forest.token)) == [1, 2, 3, 4, 5, 6]
    assert len(every) == len(every[["a", "b"]].drop_duplicates()) == 40 * 39 // 2 and not every.more.any()
