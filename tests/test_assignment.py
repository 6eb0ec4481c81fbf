import itertools
import time
import tracemalloc

import numpy as np

from watchframe.helpers.assignment import heaviest_pairs


def heaviest(left, right, weight):
    """By trying every matching."""
    best = 0.0
    for n in range(len(weight) + 1):
        for chosen in itertools.combinations(range(len(weight)), n):
            if len({left[e] for e in chosen}) == n == len({right[e] for e in chosen}):
                best = max(best, sum(weight[e] for e in chosen))
    return best


def test_matching_is_heaviest():
    rng = np.random.default_rng(0)
    for k in range(600):
        n = int(rng.integers(0, 10))
        left, right = rng.integers(0, 5, n), rng.integers(0, 5, n) + 100
        weight = rng.integers(1, 9, n) if k % 2 else rng.random(n) + 0.01
        got = heaviest_pairs(left, right, weight)
        assert len(set(left[got])) == len(got) == len(set(right[got]))
        assert abs(weight[got].sum() - heaviest(left, right, weight)) < 1e-9


def test_matching_of_dense_tables_equals_relaxation():
    """Auction-free check on larger tables: prices of a matching's dual bound its weight from above."""
    rng = np.random.default_rng(1)
    for n in (20, 60):
        table = rng.random((n, n + 5))
        left, right = (x.ravel() for x in np.indices(table.shape))
        got = heaviest_pairs(left, right, table.ravel())
        assert len(got) == n
        # no exchange of two or three partners gains anything
        of = dict(zip(left[got].tolist(), right[got].tolist(), strict=True))
        for a, b, c in itertools.islice(itertools.permutations(range(n), 3), 20_000):
            assert table[a, of[a]] + table[b, of[b]] + table[c, of[c]] >= table[a, of[b]] + table[b, of[c]] + table[c, of[a]] - 1e-9


def test_a_component_of_fifty_thousand_trajectories():
    """A chain of confusions that ties 50,000 trajectories of either side together: memory grows with the pairs."""
    rng, n = np.random.default_rng(2), 50_000
    left = np.concatenate([np.arange(n), np.arange(n - 1), rng.integers(0, n, n)])
    right = np.concatenate([np.arange(n), np.arange(1, n), np.minimum(n - 1, left[-n:] + rng.integers(0, 9, n))])
    weight = rng.integers(1, 1_000, len(left))
    tracemalloc.start()
    began = time.time()
    got = heaviest_pairs(left, right, weight)
    taken, (_, peak) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(set(left[got])) == len(got) == len(set(right[got]))
    print(f"{taken:.1f} s, {peak / 1e6:.0f} MB")
    assert peak < 200e6  # a table of all pairs would have 2.5e9 cells
