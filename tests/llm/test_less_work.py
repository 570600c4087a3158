"""Results that stay as they were while a step does less."""

import numpy as np

from arclet.llm import decontaminate


def test_only_windows_that_share_shingles_with_an_item_are_looked_up(monkeypatch):
    asked = []
    named = decontaminate.BlockIndex.named
    monkeypatch.setattr(decontaminate.BlockIndex, "named", lambda self, found: asked.append(len(found)) or named(self, found))
    rng = np.random.default_rng(3)
    item = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 20))
    text = " ".join(f"x{i}" for i in rng.integers(0, 10**6, 5000))
    probes = decontaminate.Probes([(1, item)])
    (_, _, words), = decontaminate.pieces([f"{text} {item} {text}"], plain=True)
    h = words.runs(5)
    found = [(m, int(p), int(q)) for m, at, which in probes.candidates(h, 5, probes.shared(h), 0.75) for p, q in zip(at, which)]
    assert (16, 5000, 0) in found
    assert 0 < sum(asked) < 20
    # Without counts of shared shingles every window is looked up, and no window that shares enough is found there alone.
    every = [(m, int(p), int(q)) for m, at, which in probes.candidates(h, 5) for p, q in zip(at, which)]
    shared = probes.shared(h)
    assert found == [x for x in every if shared[x[1] + 16] - shared[x[1]] >= 12]
