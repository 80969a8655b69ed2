"""Forward push where terms have many users: the same masses without visiting each of them."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators.push import Rows
from tests.test_graph import pushed_by_hand


def world(n: int, few: int, seed: int) -> tuple[np.ndarray, Rows]:
    """A graph as a matrix and as rows: terms of many users and of few, and some edges."""
    rng = np.random.default_rng(seed)
    uses = np.concatenate([rng.random((n, 6)) < 0.35, rng.random((n, few)) < 3 / n], axis=1)
    uses[:7] = False
    w = np.r_[np.full(4, 0.04), 0.05, 0.06, np.full(few, 0.2)]
    direct = np.zeros((n, n))
    for _ in range(2 * n):
        a, b = rng.integers(n, size=2)
        if a != b:
            direct[a, b] += 0.45
    common = (uses * w) @ uses.T.astype(float)
    np.fill_diagonal(common, 0.0)
    m = direct + common
    total = m.sum(axis=1)
    alone = total == 0
    m[alone, alone] = 1.0
    total[alone] = 1.0
    m /= total[:, None]
    a, b = np.nonzero((direct > 0) | np.diag(alone))
    u, t = np.nonzero(uses)
    used, by = np.nonzero(uses.T)
    most = np.zeros(n)
    np.maximum.at(most, a, m[a, b])
    most = np.maximum(most, (uses * w).sum(axis=1) / total)
    return m, Rows(np.arange(n), (a, b, m[a, b]), (u, t, w[t] / total[u]), (used, by), most, np.ones(n, bool))


@pytest.mark.parametrize(("eps", "top"), [(1e-5, 20), (2e-4, 20), (2e-4, 1000), (1e-3, 5), (4e-3, 50)])
@pytest.mark.parametrize("few", [0, 40])
def test_stars_equal_a_queue_over_the_matrix(eps, top, few):
    m, rows = world(300, few, 3)
    for own in ({0: 1.0}, {20: 1.0}, {131: 1.0}, {250: 1.0}, {30: 0.5, 40: 0.3, 2: 0.2}):
        want = pushed_by_hand(m, own, 0.5, eps)
        best = sorted((i for i in range(300) if want[i] > 0), key=lambda i: (-round(want[i], 12), i))[:top]
        nodes, masses, lacking = rows.push(np.array(sorted(own)), np.array([own[k] for k in sorted(own)]), 0.5, eps, top)
        assert not lacking and masses == pytest.approx(want[best], abs=1e-15)
        # what by hand and here is summed up in another order may differ in its last bit
        assert np.allclose(want[nodes], want[best], rtol=0, atol=1e-12)


def test_users_of_common_terms_are_not_listed():
    """A push keeps bits of users a term, and no list of a node's neighbours through terms; every array is clean again."""
    m, rows = world(600, 0, 4)
    for seed in (s for s in range(7, 40) if rows.term_first[s] < rows.term_first[s + 1]):
        nodes, masses, _ = rows.push(np.array([seed]), np.array([1.0]), 0.5, 1e-3, 20)
        assert len(nodes) == 20 and masses == pytest.approx(np.sort(masses)[::-1])
    assert not rows.whole and len(rows.sets) <= 6
    assert not (rows.mass.any() or rows.residual.any() or rows.seen.any() or rows.flags.any())
