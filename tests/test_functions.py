import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.functions import phasing as P
from strandloom.functions import search as S

NAN = np.nan


# Expected break points of worked examples.
@pytest.mark.parametrize("x, expected", [([0, 0, 0, 1, 1, 1], (3, 0)), ([0, 0, 1, 1, 1, 1], (2, 0)), ([NAN, 0, 1, 1, 1, 1], (2, 0)), ([0, 0, 0, NAN, 1, 2], (3, 1))])
def test_single_breakpoint(x, expected):
    zero, one = np.zeros(6), np.ones(6)
    assert P.single_breakpoint(np.array(x, float), zero, zero, one) == expected


def test_connect_pairs_and_error():
    # A worked example of four windows.
    pairs = [list(itertools.product(a, b)) for a, b in (((1, 2, 3), (4, 5, 6)), ((1, 2, 6), (5, 7, 8)), ((1, 3), (1, 5)), ((4, 5, 8), (4, 6, 8)))]
    assert P.connect_pairs(pairs) == (1.0, [(1, 5), (1, 5), (1, 5), (5, 4)])
    assert [P.pair_error(*p) for p in (((1, 2), (2, 3)), ((2, 5), (5, 2)), ((1, 2), (3, 4)))] == [1, 0, 4]


def test_fewest_flips():
    assert P.fewest_flips([0, 1, 1, 1], [1, 0, 0, 0]) == 0
    assert P.fewest_flips([0, 1, 0, 0, 1], [1, 0, 1, 0, 0]) == 2


bits = st.lists(st.integers(0, 1), min_size=5, max_size=5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 2.0, NAN]), min_size=5, max_size=5), bits, bits, bits, bits)
def test_double_breakpoint_is_the_first_least(x, i, k, j, l):
    x, i, k, j, l = (np.array(v, float) for v in (x, i, k, j, l))
    seen = ~np.isnan(x)

    def error(b1, b2):
        s1 = np.where(np.arange(5) < b1, i, k)
        s2 = np.where(np.arange(5) < b2, j, l)
        return ((x - s1 - s2)[seen] ** 2).sum()

    least = min((error(a, b), a, b) for a in range(6) for b in range(6))
    assert P.double_breakpoint(x, i, k, j, l) == (least[1], least[2], least[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(bits, min_size=1, max_size=7, unique_by=tuple), st.lists(st.sampled_from([0.0, 0.5, 1.0, 2.0]), min_size=5, max_size=5))
def test_searches_against_loops(h, x):
    h, x = np.array(h, float), np.array(x)
    pairs = [(round(float(((x - h[j] - h[k]) ** 2).sum()), 6), k, j) for k in range(len(h)) for j in range(k + 1)]
    least = min(pairs)
    one = lambda found: next(iter(found))
    x = x[None, :]
    assert one(S.best_pairs(x, h)) == (least[2], least[1], least[0])
    first = pairs.index(least)
    kept = [p for p in pairs[first:] if p[0] <= least[0] + 3][:100]
    assert one(S.rescreened(x, h, np.ones((1, 5), bool)))[2] == pytest.approx(min(p[0] for p in kept))
    assert one(S.stepwise(x, h, r=len(h)))[2] == least[0]
    assert one(S.thinned(x, h, len(h)))[2] == least[0]


weight = st.lists(st.sampled_from([0.5, 1.0, 3.0]), min_size=6, max_size=6)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), weight, st.integers(1, 5))
def test_weighted_searches_against_loops(seed, w, r):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 2, (9, 6)), axis=0).astype(float)
    x, w = rng.integers(0, 3, (3, 6)).astype(float), np.array(w)
    error = lambda s, j, k: round(float((w * (s - h[j] - h[k]) ** 2).sum()), 6)
    for s, found in zip(x, S.best_pairs(x, h, w)):
        assert found == min((error(s, j, k), k, j) for k in range(len(h)) for j in range(k + 1))[::-1]
    for s, (j, k, score) in zip(x, S.stepwise(x, h, r, w)):
        n = [(-round(float(2 * (w * s * row).sum()), 6), i) for i, row in enumerate(h)]
        top = [i for _, i in sorted(n)[:r]]
        assert score == error(s, j, k) and (r >= len(h) or score == min(error(s, i, b) for i in top for b in range(len(h))))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_a_noise_free_target_is_found(seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 2, (12, 8)), axis=0).astype(float)
    x = h[rng.integers(0, len(h), 5)] + h[rng.integers(0, len(h), 5)]
    for strategy in (S.rescreened(x, h, np.ones(x.shape, bool)), S.best_pairs(x, h, np.full(8, 2.0)), S.thinned(x, h, len(h))):
        assert all(score == 0 and (h[j] + h[k] == s).all() for s, (j, k, score) in zip(x, strategy))


def test_survivor_fold_tiles_and_restarts():
    one, two = P.survivor_fold([[1, 2, 3], [2, 3], [9]], [[5, 6], [6, 7], [6]])
    assert (one, two) == ([2, 2, 9], [6, 6, 6])
    assert P.survivor_fold([[1], [5]], [[5], [1]]) == ([1, 1], [5, 5])  # crossed over


def test_mosaic_forms_tile_the_range():
    labels, ranges = [4, 4, 7], [(1, 3), (4, 6), (7, 9)]
    assert P.segments_by_label(labels, [-1, 2], ranges) == [(1, 4, 1), (6, 7, 3)]
    found = P.segments_by_window(labels, [-1, 2], ranges)
    starts = [s for s, _, _ in found]
    assert starts[0] == 1 and starts == sorted(set(starts)) and found[-1] == (7, 7, 3)


def test_frequency_weight():
    assert S.frequency_weight(np.array([0.1, 0.5, 0.99])) == pytest.approx([1.98, 1 / np.sqrt(0.5), 1 / np.sqrt(2 * 0.85 * 0.15)])
