"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models of order `ORDER` give the next letter of a word, one counted on toxic and one on ordinary texts. Only the
longest context is counted per class; all shorter ones are shared, with continuation counts over both classes. So where a
class has no evidence about a letter, both models fall back to the same numbers and the comparison says nothing, and a
rare form of a toxic expression is recognised by the letters it shares with others.

For every word the toxic and ordinary log-likelihoods are compared per letter. A text is described by its most toxic
word, by its three most toxic words, by the mean over all its letters and by its length, and a logistic function of these
is its score. Models are counted on three quarters of a sample of labelled texts, about `FIT_TOXIC` toxic and
`FIT_ORDINARY` ordinary ones at most (chosen by the hash of their id), and the function is fitted on the last quarter, with
weights that undo the unequal shares. Every whole text is scored.

A gram is a row of `ORDER` numbers, its letters at the right end, and is known by a 64-bit sum of letters times fixed odd
factors. The models are sorted arrays of these sums; no gram is a Python object on the driver or in the model.

Null and empty texts have no words and get the score of an all-neutral text. Texts without an id are scored and never
learnt from. Several labels of one id: the highest counts. Without labels of both classes every score is zero. Extra
columns are ignored; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .workers import Memo

FIT_TOXIC = 1_200
FIT_ORDINARY = 1_500
PARTS = 4
ORDER = 9
TOP = 3
EASE = 5
FEATURES = ("peak", "top", "mean", "words")
START, END = "\x02", "\x03"
THRESHOLD = 0.3
FACTORS = np.random.default_rng(ORDER).integers(0, 2**64, ORDER, np.uint64) | np.uint64(1)
WORDS_AT_ONCE = 10_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of marked words as numbers from one, each word after `ORDER` - 1 zeros; the place where the gram of each
    letter and end begins; the number of these per word."""
    gap = ORDER - 1
    joined = "".join(" " * gap + START + w + END for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    n = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(n + 1 + gap) - (n + 1 + gap)
    codes[(starts[:, None] + np.arange(gap)).ravel()] = 0
    at = np.arange(n.sum()) + np.repeat(starts + 1 - (np.cumsum(n) - n), n)
    return codes, at, n


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of the words and their ends, the letter with up to `ORDER` - 1 letters before it; grams per word."""
    codes, at, n = letters_of(words)
    return codes[at[:, None] + np.arange(ORDER)], n


def hashed(rows: np.ndarray) -> np.ndarray:
    """What grams, one per row, are known by."""
    total = np.zeros(len(rows), np.uint64)
    for column, factor in zip(rows.T, FACTORS, strict=True):
        total += column.astype(np.uint64) * factor
    return total


def without_last(rows: np.ndarray) -> np.ndarray:
    """The contexts of grams: all letters but the last."""
    context = np.zeros_like(rows)
    context[:, 1:] = rows[:, :-1]
    return context


def without_first(rows: np.ndarray) -> np.ndarray:
    rest = rows.copy()
    rest[np.arange(len(rows)), (rows == 0).sum(axis=1)] = 0
    return rest


def discount(counts: np.ndarray) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def per_group(groups: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the sum of the counts in its group and the number of those above zero."""
    _, place = np.unique(groups, return_inverse=True)
    return np.bincount(place, counts)[place], np.bincount(place, counts > 0)[place]


def find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted `keys`, which are not empty, and whether the key there is the one asked for."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def shared_backoff(longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kneser-Ney probabilities of a letter after a shorter context, over both classes: sorted keys and values.

    Shorter grams get one for each different letter before them; those at the start of a word have none and stay.
    """
    length = ORDER - (longest == 0).sum(axis=1)
    level, levels = longest[:0], []
    for n in range(ORDER, 1, -1):
        level = np.concatenate([level, longest[length == n]])
        level = level[np.unique(hashed(level), return_index=True)[1]]
        if len(level):
            rest = without_first(level)
            keys, first, counts = np.unique(hashed(rest), return_index=True, return_counts=True)
            level = rest[first]
            # The key of a gram without its first letter, and that of its context.
            levels.append((keys, counts, hashed(without_first(level)), hashed(without_last(level))))
    d = discount(np.concatenate([counts for _, counts, _, _ in levels]))
    found = []
    for keys, counts, shorter, contexts in reversed(levels):
        lower = found[-1][1][find(found[-1][0], shorter)[0]] if found else 1 / (len(keys) + 1)
        total, kinds = per_group(contexts, counts)
        found.append((keys, np.maximum(counts - d, 0) / total + d * kinds / total * lower))
    keys, values = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.argsort(keys)
    return keys[order], values[order]


class Ratios(NamedTuple):
    """Log ratios of grams, and of contexts for letters that neither class has seen after them (the shared probability
    cancels there); keys are sorted."""

    grams: np.ndarray
    seen: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray

    def __call__(self, grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        at, known = find(self.grams, grams)
        in_context, has = find(self.contexts, contexts)
        return np.where(known, self.seen[at], np.where(has, self.unseen[in_context], 0.0))


def likelihood_ratios(longest: np.ndarray, counts: np.ndarray) -> Ratios:
    """The comparison of two classes, from different grams of full length and their (toxic, ordinary) counts."""
    keys = hashed(longest)
    order = np.argsort(keys)
    longest, counts, keys = longest[order], counts[order], keys[order]
    known, values = shared_backoff(longest)
    shared = values[find(known, hashed(without_first(longest)))[0]]
    contexts = hashed(without_last(longest))
    p, weights = [], []
    for own in counts.T:
        d = discount(own)
        total, kinds = per_group(contexts, own)
        some = np.maximum(total, 1)
        weights.append(np.where(total > 0, d * kinds / some, 1.0))
        p.append(np.maximum(own - d, 0) / some + weights[-1] * shared)
    in_context, first = np.unique(contexts, return_index=True)
    return Ratios(keys, np.log(p[0] / p[1]), in_context, np.log(weights[0] / weights[1])[first])


class WordScores:
    """Per word: its log ratio per letter (short words are held back by `EASE` letters), its log ratio, its letters."""

    def __init__(self, ratios: Ratios):
        self.ratios = ratios
        self.memo = Memo(lambda word: next(self._scored([word])))

    def _scored(self, words: list[str]) -> Iterator[tuple[float, float, int]]:
        codes, at, n = letters_of(words)
        whole, context = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for j in range(ORDER):
            letters = codes[at + j].astype(np.uint64)
            whole += letters * FACTORS[j]
            if j < ORDER - 1:
                context += letters * FACTORS[j + 1]
        # Rounded, so that a word gets the same number whichever words it is scored with.
        totals = np.round(np.add.reduceat(self.ratios(whole, context), np.cumsum(n) - n), 9)
        for total, letters in zip(totals.tolist(), n.tolist(), strict=True):
            yield total / (letters + EASE), total, letters

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if not self.memo.known(w)]
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            for word, value in zip(part, self._scored(part), strict=True):
                self.memo.keep(word, value)

    def features(self, text: str | None) -> tuple[float, ...]:
        """The largest ratio per letter of a word, the mean of the `TOP` largest of different words, the ratio per letter
        of the whole text, and the logarithm of its words."""
        words = Counter(words_of(text))
        if not words:
            return 0.0, 0.0, 0.0, 0.0
        self.learn(words)
        values = [self.memo[w] for w in words]
        largest = heapq.nlargest(TOP, set(values))
        top = sum(max(v[0], 0.0) for v in largest) / TOP
        total = sum(v[1] * times for v, times in zip(values, words.values(), strict=True))
        letters = sum(v[2] * times for v, times in zip(values, words.values(), strict=True))
        return largest[0][0], top, total / letters, math.log(words.total())


def logistic_fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last one constant) of a ridge-regularised logistic function, by Newton steps."""
    share = np.ones(len(x)) if weight is None else weight / weight.mean()
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (share * p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(hessian, z.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_toxic: int, fit_ordinary: int
) -> DataFrame:
    """A written table of labelled texts that are not held out: id, toxic, weight, text, part (0..3)."""
    allowed = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by_id = allowed.groupBy(F.col("doc_id").alias("id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    n = by_id.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary")).first()
    shares = (min(1.0, fit_toxic / max(1, n.toxic)), min(1.0, fit_ordinary / max(1, n.ordinary)))
    share = F.when(F.col("toxic") == 1, shares[0]).otherwise(shares[1])
    place = F.pmod(F.xxhash64("id"), F.lit(2**30)) / F.lit(2.0**30)
    # About `fit_toxic` and `fit_ordinary` ids with their labels: a broadcast of bounded size.
    chosen = F.broadcast(by_id.withColumn("weight", 1 / share).filter(place < share))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(chosen, "id")
    part = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(PARTS)).cast("int")
    return stored(rows.withColumn("part", part), "labelled-texts")


def gram_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of full length in a bounded sample, one per row, and their (toxic, ordinary) counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words[0 if toxic else 1].update(words_of(text))
            different = sorted(words[0].keys() | words[1].keys())
            for at in range(0, len(different), WORDS_AT_ONCE):
                part = different[at : at + WORDS_AT_ONCE]
                rows, n = grams(part)
                _, first, place = np.unique(hashed(rows), return_index=True, return_inverse=True)
                sums = [np.bincount(place, np.repeat([own[w] for w in part], n)).astype(np.int64) for own in words]
                found = [row.tobytes() for row in rows[first]]
                yield pd.DataFrame({"gram": found, "toxic": sums[0], "ordinary": sums[1]})

    counted = sample.select("text", "toxic").mapInPandas(count, "gram binary, toxic bigint, ordinary bigint")
    # The sample is bounded, and so are its grams; they arrive as Arrow batches and are copied batch by batch.
    table = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
    rows = [np.frombuffer(b"".join(part.to_pylist()), np.uint32) for part in table["gram"].chunks]
    counts = np.stack([table[c].to_numpy() for c in ("toxic", "ordinary")], axis=1).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *rows]).reshape(-1, ORDER), counts


def text_features(spark: SparkSession, ratios: Ratios) -> Callable:
    """A column function that describes a text."""
    # The model is as large as the sample is, which `FIT_TOXIC` and `FIT_ORDINARY` bound.
    shared = spark.sparkContext.broadcast(tuple(ratios))

    @F.pandas_udf(", ".join(f"{name} double" for name in FEATURES))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = WordScores(Ratios(*shared.value))
        for texts in batches:
            yield pd.DataFrame([scores.features(t) for t in texts], columns=list(FEATURES), dtype="float64")

    return features


def score_texts(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = THRESHOLD,
    fit_toxic: int = FIT_TOXIC,
    fit_ordinary: int = FIT_ORDINARY,
) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    sample = labelled_sample(docs, labels, key, text, label, fit_toxic, fit_ordinary)
    longest, counts = gram_counts(sample.filter("part < 3"))
    fitted = None
    if counts.any(axis=0).all():
        features = text_features(docs.sparkSession, likelihood_ratios(longest, counts))
        known = sample.select("toxic", "weight", "part", features("text").alias("f")).select("*", "f.*").toPandas()
        # Too few labels for a quarter of their own: all of them.
        fresh = known[known["part"] == 3] if known[known["part"] == 3]["toxic"].nunique() == 2 else known
        fresh = fresh.sort_values(["toxic", *FEATURES])
        fitted = logistic_fit(*(fresh[c].to_numpy(float) for c in (list(FEATURES), "toxic", "weight")))
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    if fitted is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        mean, scale, weights = ([float(v) for v in part] for part in fitted)
        linear = F.lit(weights[-1])
        for i, name in enumerate(FEATURES):
            linear += F.lit(weights[i] / scale[i]) * (F.col("f")[name] - mean[i])
        scored = rows.withColumn("f", features("text")).withColumn("score", 1 / (1 + F.exp(-linear)))
    return scored.select(
        key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
