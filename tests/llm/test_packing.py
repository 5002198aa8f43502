"""Sequences of the configuration program against known optima and bounds."""

import math
import random

import numpy as np
import pytest

from weftline.llm import packing

CAPACITY = packing.CAPACITY


def sequences(items, **how):
    histogram = {}
    for x in items:
        histogram[x] = histogram.get(x, 0) + 1
    found = packing.solve(histogram, **how)
    used = {}
    for pattern, times in found:
        assert times > 0 and sum(length * each for length, each in pattern.items()) <= how.get("capacity", CAPACITY)
        for length, each in pattern.items():
            used[length] = used.get(length, 0) + each * times
    assert used == histogram
    return sum(times for _, times in found)


def test_triples_that_fill_exactly():
    rng = random.Random(4)
    items = []
    for _ in range(3000):
        a, b = sorted(rng.sample(range(1, CAPACITY), 2))
        items += [a, b - a, CAPACITY - b]
    assert sequences(items) <= 3030


def test_hard_triples():
    rng = random.Random(5)
    items = []
    for _ in range(3000):
        a, b = rng.randint(1000, 1800), rng.randint(1000, 1700)
        items += [a, b, CAPACITY - a - b]
    assert sequences(items) <= 1.03 * 3000


@pytest.mark.parametrize("items", [[], [1], [CAPACITY], [CAPACITY, 1], [2049] * 7, [1] * 10_000, [1365] * 30, [3000, 1096] * 50])
def test_small_cases(items):
    least = max(math.ceil(sum(items) / CAPACITY), sum(x > CAPACITY / 2 for x in items))
    assert sequences(items, steps=50) == least


def test_against_all_partitions():
    def best(items, bins=()):
        if not items:
            return len(bins)
        tries = {b for b in bins if b >= items[0]}
        found = [best(items[1:], tuple(sorted([*bins[: bins.index(b)], *bins[bins.index(b) + 1 :], b - items[0]]))) for b in tries]
        return min([*found, best(items[1:], (*bins, 20 - items[0]))])

    rng = random.Random(6)
    for _ in range(15):
        items = [rng.randint(1, 20) for _ in range(7)]
        assert sequences(items, capacity=20, steps=60) == best(items)


def test_bound_and_fraction():
    need = np.zeros(21, np.int64)
    need[[7, 9, 11]] = 300, 200, 250
    counts, bound = packing.fractional(need, 20, 3000, 1)
    assert 0 < bound <= sum(times for _, times in packing.solve({7: 300, 9: 200, 11: 250}, 20, 3000))
    for length in (7, 9, 11):
        assert sum(dict(key).get(length, 0) * x for key, x in counts.items()) <= need[length] * (1 + 1e-9)


def test_lengths_come_back_rounded_to_the_grid():
    price = np.zeros(CAPACITY + 1)
    price[[1000, 1001, 3096]] = 0.3, 0.31, 0.8
    pattern = packing._best_pattern(price, CAPACITY, 4)
    assert sum(k * v for k, v in pattern.items()) <= CAPACITY and pattern == {1000: 1, 3096: 1} or pattern == {1001: 4}
