import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terravane.llm.packing import best_fit, plan_sequences, reduce_by_dominance, sequence_lengths


def used(patterns):
    out = {}
    for runs, times in patterns:
        for w, k in runs:
            out[w] = out.get(w, 0) + k * times
    return out


def optimum(items, capacity):
    """Fewest bins by search over all ways to place the items."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= items[i]:
                rest = list(bins)
                rest.remove(b)
                go(i + 1, [*rest, b - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0] if items else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_keeps_the_optimum(items):
    counts = {w: items.count(w) for w in set(items)}
    fixed, rest = reduce_by_dominance(counts, 20)
    left = [w for w, n in rest.items() for _ in range(n)]
    assert optimum(sorted(items, reverse=True), 20) == sum(t for _, t in fixed) + optimum(sorted(left, reverse=True), 20)
    total = used(fixed)
    assert {w: total.get(w, 0) + rest.get(w, 0) for w in counts} == counts


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_every_piece_has_one_place(counts):
    patterns = plan_sequences(counts, 64)
    assert used(patterns) == counts
    assert all(0 < n <= 64 for n in sequence_lengths(patterns))


def best_fit_one_by_one(items, capacity):
    bins = []
    for w in sorted(items, reverse=True):
        fitting = [i for i, r in enumerate(bins) if r >= w]
        if fitting:
            bins[min(fitting, key=lambda i: bins[i])] -= w
        else:
            bins.append(capacity - w)
    return len(bins)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_uses_as_many_sequences_as_one_by_one(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 40) for _ in range(rng.randint(0, 300))]
    counts = {w: items.count(w) for w in set(items)}
    assert sum(t for _, t in best_fit(counts, 64)) == best_fit_one_by_one(items, 64)


def test_length_out_of_range():
    with pytest.raises(ValueError):
        plan_sequences({65: 1}, 64)
