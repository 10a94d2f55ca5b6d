"""The Kneser-Ney models of op5 against a slow version over strings, and the scores of words that rest on them."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from ratewright.llm import toxicity
from ratewright.llm.toxicity import END, ORDER, START


def slow_grams(word):
    marked = START + word + END
    return [marked[max(0, i - ORDER) : i] for i in range(2, len(marked) + 1)]


def slow_discount(counts):
    ones, twos = (sum(c == n for c in counts) for n in (1, 2))
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


class Slow:
    """`counts` has the (toxic, ordinary) counts of the longest grams."""

    def __init__(self, counts):
        self.counts = counts
        known = {g[i:] for g in counts for i in range(len(g) - 1)}
        self.before = Counter(g[1:] for g in known)
        self.d = slow_discount(self.before.values())

    def shared(self, gram):
        if not gram:
            return 1 / (sum(len(g) == 1 for g in self.before) + 1)
        after = [n for g, n in self.before.items() if g[:-1] == gram[:-1]]
        lower = self.shared(gram[1:])
        if not after:
            return lower
        return (max(self.before[gram] - self.d, 0) + self.d * len(after) * lower) / sum(after)

    def probability(self, k, gram, shared):
        d = slow_discount([pair[k] for pair in self.counts.values()])
        after = [pair[k] for g, pair in self.counts.items() if g[:-1] == gram[:-1] and pair[k]]
        if not after:
            return shared
        return (max(self.counts.get(gram, (0, 0))[k] - d, 0) + d * len(after) * shared) / sum(after)

    def ratio(self, gram):
        shared = self.shared(gram[1:]) if gram in self.counts else 0.5
        return math.log(self.probability(0, gram, shared) / self.probability(1, gram, shared))


def some_words(seed, n):
    chance = random.Random(seed)
    return ["".join(chance.choice("ab\u00e9\U0001f600\x00") for _ in range(chance.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_ratios_equal_a_slow_kneser_ney_model(seed):
    chance = random.Random(seed)
    pairs = Counter()
    for word in some_words(seed, 25):
        for gram in slow_grams(word):
            pairs[gram] += chance.choice([1, 1, 2])
    counts = {g: (n, 0) if chance.random() < 0.4 else (chance.randint(0, 3), n) for g, n in pairs.items()}
    rows = np.zeros((len(counts), ORDER), np.uint32)
    for row, gram in zip(rows, counts, strict=True):
        row[ORDER - len(gram) :] = [ord(c) + 1 for c in gram]
    slow = Slow(counts)
    ratios = toxicity.likelihood_ratios(rows, np.array(list(counts.values())))
    expected = dict(zip(toxicity.hashed(rows).tolist(), map(slow.ratio, counts), strict=True))
    assert dict(zip(ratios.grams.tolist(), ratios.seen, strict=True)) == pytest.approx(expected)

    words = some_words(seed, 5) + some_words(seed + 100, 30) + ["", "zz"]
    scores = toxicity.WordScores(ratios)
    scores.learn(words)
    for word in words:
        total = sum(slow.ratio(g) for g in slow_grams(word))
        assert scores.memo[word] == pytest.approx((total / (len(word) + 1 + toxicity.EASE), total, len(word) + 1), abs=1e-8)


def test_counts_of_a_sample(spark):
    rows = [("ab Ab c", 1), ("ab", 0), (None, 1), ("", 0), ("x" * 30, 0)]
    sample = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    longest, counts = toxicity.gram_counts(sample)
    found = {"".join(chr(c - 1) for c in row if c): tuple(n) for row, n in zip(longest, counts.tolist(), strict=True)}
    expected = {}
    for text, toxic in rows:
        for word in (text or "").lower().split():
            for gram in slow_grams(word):
                t, o = expected.get(gram, (0, 0))
                expected[gram] = (t + toxic, o + 1 - toxic)
    assert found == expected
    assert [part.shape for part in toxicity.gram_counts(sample.limit(0))] == [(0, ORDER), (0, 2)]
