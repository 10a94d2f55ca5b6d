"""Quality rules and an isolation forest over their statistics.

`rule_stats` takes words, symbols, repeated lines and repeated five-word windows of a whole text. The base rules reject
very short and very repetitive texts. Beyond them isolation forests, one per group of rules, judge the shares that these
numbers form: trees split at random, and a text that random splits isolate after few steps is an anomaly. Trees are grown
on labelled rows, about `FIT_ROWS` of them at most (chosen by the hash of their id), and the score above which a
forest rejects comes from the scores of *all* labelled rows: the largest gain of caught low-quality rows over lost good
ones, with at most `MAX_LOSS` of the good ones lost. A group whose anomalies are not of low quality rejects nothing.

Null and empty texts have zero words and fail the base rules. Rows without an id have no label and are judged like any
other; repeated rows are judged alike. Several labels of one id: the lowest counts. Without labels of both kinds the base
rules decide alone. Other columns pass through or are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

FIT_ROWS = 10_000
MAX_LOSS = 0.001
MIN_GAIN = 0.05
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "

STAT_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
STATS = T.StructType([T.StructField(name, T.LongType()) for name in STAT_NAMES])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, again = set(), set()
    for gram in grams:
        (again if gram in seen else seen).add(gram)
    total, covered = 0, 0
    for i, gram in enumerate(grams):
        if gram in again:
            total += i + window - max(i, covered)
            covered = i + window
    return total


def stats_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, repeats, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            repeats += line in seen
            seen.add(line)
    word_chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), word_chars, symbols, repeats, repeated_words(words), lines


@F.pandas_udf(STATS)
def rule_stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([stats_of(t) for t in batch], columns=STAT_NAMES, dtype="int64")


def base_failed(stats: str) -> Column:
    """The base rules, on a column of `rule_stats`."""
    n = F.col(f"{stats}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def views(stats: pd.DataFrame) -> list[np.ndarray]:
    """What the forests see, one table of points per group of rules: symbols, repetition, shape of words."""
    x = {name: stats[name].to_numpy(float) for name in STAT_NAMES}
    words, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    symbols = [np.sqrt(x["n_symbols"] / chars), x["n_symbols"] / words, np.log1p(x["n_symbols"])]
    repetition = [x["n_dup_lines"] / np.maximum(x["n_lines"], 1), x["n_repeat_words"] / words]
    shape = [x["word_chars"] / words, words / np.maximum(x["n_lines"], 1)]
    return [np.stack(columns, axis=1) for columns in (symbols, repetition, shape)]


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean steps of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 for a leaf), split value, left child (the right one follows), path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    usual: float
    depth: int

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): near 1 for points that few random splits isolate."""
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for feature, value, left, path in zip(self.feature, self.value, self.left, self.path, strict=True):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = points[rows, np.maximum(f, 0)] >= value[node]
                node = np.where(f < 0, node, left[node] + right)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def grow_forest(points: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 7) -> Forest:
    """An isolation forest over the rows of `points`, two at least."""
    random = np.random.default_rng(seed)
    size = min(sample, len(points))
    depth = max(1, int(np.ceil(np.log2(size))))
    width = 2 ** (depth + 1)
    kinds = {"feature": np.int64, "value": float, "left": np.int64, "path": float}
    arrays = {k: np.full((trees, width), -1 if k == "feature" else 0, t) for k, t in kinds.items()}
    for t in range(trees):
        chosen = points[random.choice(len(points), size, replace=False)]
        waiting, used = [(0, chosen, 0)], 1
        while waiting:
            node, own, level = waiting.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            varied = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(varied):
                arrays["path"][t, node] = level + float(_average_path(len(own)))
                continue
            f = random.choice(varied)
            value = random.uniform(low[f], high[f])
            value = high[f] if value <= low[f] else value  # both sides get rows
            goes_right = own[:, f] >= value
            arrays["feature"][t, node], arrays["value"][t, node], arrays["left"][t, node] = f, value, used
            waiting += [(used, own[~goes_right], level + 1), (used + 1, own[goes_right], level + 1)]
            used += 2
    return Forest(**arrays, usual=max(float(_average_path(size)), 1e-9), depth=depth)


SCORE_STEPS = 1_000


def _steps(forests: list[Forest]):
    """The score of each forest in thousandths."""

    @F.pandas_udf("array<int>")
    def steps(stats: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in stats:
            scores = [f.scores(points) for f, points in zip(forests, views(batch), strict=True)]
            yield pd.Series(list(np.floor(np.stack(scores, axis=1) * SCORE_STEPS).astype(np.int32)))

    return steps


def threshold_of(counts: pd.DataFrame, max_loss: float = MAX_LOSS, min_gain: float = MIN_GAIN) -> int:
    """The score step above which a text is rejected, from rows (step, good, bad); SCORE_STEPS rejects nothing.

    It gives the largest share of caught bad rows less the share of lost good rows, with at most `max_loss` of the good
    rows lost, and a gain of at least `min_gain`. Of equal gains the highest step counts.
    """
    good, bad = counts["good"].sum(), counts["bad"].sum()
    if not good or not bad:
        return SCORE_STEPS
    down = counts.sort_values("step", ascending=False)
    lost, caught = (down[c].to_numpy().cumsum() / n for c, n in (("good", good), ("bad", bad)))
    gain = np.where(lost <= max_loss, caught - lost, 0)
    best = int(gain.argmax())
    return int(down["step"].iloc[best]) - 1 if gain[best] >= min_gain else SCORE_STEPS


def judge(
    rated: DataFrame,
    labels: DataFrame,
    key: str,
    stats: str,
    verdict: str,
    label: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """`rated`, a written table with a `rule_stats` column, with the boolean column `verdict` (true: keep)."""
    by_id = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("good"))
    known = rated.select(F.col(key).alias("id"), F.col(stats).alias("stats")).filter(~base_failed("stats"))
    labelled = stored(known.join(by_id, "id"), "labelled")
    share = min(1.0, fit_rows / max(1, labelled.count()))
    chosen = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(2**30)) < int(share * 2**30))
    sample = chosen.select("stats.*").sort(*STAT_NAMES).toPandas()
    if len(sample) < 2:
        return rated.withColumn(verdict, ~base_failed(stats))
    forests = [grow_forest(points) for points in views(sample)]
    scored = labelled.select(F.posexplode(_steps(forests)("stats")).alias("forest", "step"), (F.col("good") > 0).alias("good"))
    tally = scored.groupBy("forest", "step").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )  # at most SCORE_STEPS + 1 rows per forest
    counts = tally.toPandas()
    cuts = [threshold_of(counts[counts["forest"] == i]) for i in range(len(forests))]
    steps = _steps(forests)(F.col(stats))
    passes = F.forall(F.zip_with(steps, F.array(*map(F.lit, cuts)), lambda step, cut: step <= cut), lambda ok: ok)
    return rated.withColumn(verdict, ~base_failed(stats) & passes)
