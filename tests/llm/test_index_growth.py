"""Work of decontamination on texts that share nothing with the benchmark must not grow with its items."""

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import decontaminate as D


@pytest.mark.parametrize("n", [50, 3000])
def test_few_random_windows_are_compared_with_items(monkeypatch, n):
    r = np.random.default_rng(1)
    word = lambda k: " ".join(f"w{i}" for i in r.integers(0, 20_000, k))
    items = D.Items([(i, word(60)) for i in range(n)], 21)
    asked = []
    real = D.HammingIndex.near
    monkeypatch.setattr(D.HammingIndex, "near", lambda self, prints, worth: asked.append((len(prints), int(worth.sum()))) or real(self, prints, worth))
    assert items.matches(pa.array([word(3000) for _ in range(20)]), 0.75) == {}
    assert sum(a for a, _ in asked) > 5000 and sum(b for _, b in asked) < 0.05 * sum(a for a, _ in asked)


def test_passages_among_many_items_are_still_found():
    r = np.random.default_rng(2)
    word = lambda k: " ".join(f"w{i}" for i in r.integers(0, 5000, k))
    texts = [word(60) for _ in range(2000)]
    items = D.Items(list(enumerate(texts)), 21)
    changed = [t.split() for t in texts[::100]]
    for t in changed:
        t[17] = "other"
    found = items.matches(pa.array([f"{word(200)} {' '.join(t)} {word(100)}" for t in changed]), 0.75)
    assert set(found) == {(k, 100 * k) for k in range(20)}
