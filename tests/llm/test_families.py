"""Counting shared values, whichever of its two ways a value is counted by, against plain sets."""

import numpy as np
import pytest

from callweave.llm import families


@pytest.mark.parametrize("dense", [0, 50, 4096])
@pytest.mark.parametrize("n, m, values, most", [(5, 7, 20, 6), (40, 30, 50, 20), (0, 3, 9, 2), (120, 90, 300, 60)])
def test_shared_counts(monkeypatch, dense, n, m, values, most):
    monkeypatch.setattr(families, "DENSE", dense)
    monkeypatch.setattr(families, "LISTED", 100)
    draw = np.random.default_rng(n)
    left, right = ([draw.choice(values, draw.integers(0, most + 1), replace=False).astype(np.uint64) for _ in range(size)] for size in (n, m))
    both = lambda a, b: np.array([[len(np.intersect1d(x, y)) for y in b] for x in a]).reshape(len(a), len(b))
    assert (families.shared_counts(left, right) == both(left, right)).all()
    assert (families.shared_counts(left) == both(left, left)).all()
