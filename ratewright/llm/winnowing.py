"""Benchmark passages in training texts, found by winnowing. DataFrame operations only.

A window is ten consecutive words of a benchmark item, or all words of an item that has fewer. Texts are lower-cased (A to
Z); words are runs of ASCII letters, digits and non-ASCII characters. A word of a text inside any occurrence of a window is
hit.

Every window is represented by the least hash of the `GRAM_WORDS`-word grams in it (of shorter ones where the window itself
is shorter). Neighbouring windows mostly share their least gram, so a text keeps about half of its grams, and a span of a
window's length that stands in a text and in an item gives both the same fingerprint: none is missed. Fingerprints of texts
are joined with those of items. A hit is then extended to the windows around it, which count if they are windows of an item
word for word (two 64-bit hashes of the words). Up to `BROADCAST_PRINTS` fingerprints of items are counted and sent to all
tasks, which extend hits at once; beyond it fingerprints are shuffled, and texts with matches are read and shuffled again.

Windows of different lengths, which items of fewer than ten words cause, are searched apart, each over all texts.

Equal texts are one node from the first match on, named by two 64-bit hashes. Windows that stand in the same items are one
class, and texts with the same classes share one list of items, so a passage that stands in a third of all texts and of
all items is not written out once per pair.

Null texts, empty ones and those without words have no words and no hits, and such items no windows. Rows of one item id
are one item; rows without an id are one item together, named by an empty string. Repeated rows of texts get equal results
and a null id stays null. Extra columns are ignored. An empty table of texts gives an empty result, an empty table of items
no hits.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

WINDOW_WORDS = 10
GRAM_WORDS = 8
# A run of windows with one least gram is written again after so many windows, so a match says where to extend.
RUN_WINDOWS = 16
# So many fingerprints of items are sent to all tasks (about 100 MB as a hash table); beyond it both sides are shuffled.
BROADCAST_PRINTS = 4_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NODE = ["h1", "h2"]
KEY = ["n", "k1", "k2"]
CLASS = ["c1", "c2"]


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; `lower` is faster, but only right where there are no other letters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS, -1), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words_of(text)), F.lit(0)).cast("bigint")


def two_hashes(*values: Column | str) -> list[Column]:
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def over_runs(rows: DataFrame, values: str, width: int, combine: Callable, out: str) -> DataFrame:
    """Adds `out`: element i combines the elements i to i + width - 1 of the array `values`, by doubling.

    The last width - 1 elements combine fewer. Overlapping halves do no harm to a minimum or to a hash of a run.
    """
    size, made = 1, values
    while size < width:
        step = min(size, width - size)
        later = F.slice(made, step + 1, F.size(made))
        size += step
        rows = rows.withColumn(f"{out}{size}", F.zip_with(made, later, combine))
        made = f"{out}{size}"
    return rows.withColumnRenamed(made, out) if made != values else rows.withColumn(out, F.col(values))


def least_grams(rows: DataFrame, length: int) -> DataFrame:
    """From rows with `words`: one row per window of `length` words, with its place `s` and its least gram `m`; `words`
    and `least` (all least grams) stay."""
    gram = min(GRAM_WORDS, length)
    hashed = rows.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word)))
    grams = over_runs(hashed, "hashes", gram, lambda a, b: F.xxhash64(a, b), "grams")
    least = over_runs(grams, "grams", length - gram + 1, lambda a, b: F.least(a, b), "least")
    kept = least.select(*rows.columns, "least")
    # The outer form keeps the optimizer from testing the array's size beforehand, which would compute it twice.
    return kept.select("*", F.posexplode_outer("least").alias("s", "m")).filter(F.col("s") <= F.size("least") - length)


def starts_run() -> Column:
    return (F.col("s") % RUN_WINDOWS == 0) | (F.col("m") != F.get("least", F.col("s") - 1))


def window_key(words: Column, length: int) -> list[Column]:
    return [F.lit(length).alias("n"), *(h.alias(k) for h, k in zip(two_hashes(words), KEY[1:], strict=True))]


def item_windows(items: DataFrame, key: str, text: str) -> tuple[DataFrame, list[int]]:
    """A written table of the windows of all items (item, n, k1, k2, m), and their lengths."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = items.select(name.alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    rows = stored(rows.withColumn("length", F.least(F.size("words"), F.lit(WINDOW_WORDS))), "items")
    # At most WINDOW_WORDS values.
    lengths = sorted(r.length for r in rows.select("length").distinct().collect())
    parts = [
        least_grams(rows.filter(F.col("length") == n).select("item", "words"), n).select(
            "item", *window_key(F.slice("words", F.col("s") + 1, n), n), "m"
        )
        for n in lengths
    ]
    if not parts:
        schema = "item string, n int, k1 bigint, k2 bigint, m bigint"
        return items.sparkSession.createDataFrame([], schema), []
    return stored(reduce(DataFrame.union, parts).distinct(), "item-windows"), lengths


def matched_runs(texts: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """A written table of the nodes whose fingerprints meet those of items: n, node, one of its ids, places to extend."""
    found = []
    for length in lengths:
        windows = least_grams(texts.select("id", *NODE, words_of(F.col("text")).alias("words")), length)
        own = prints.filter(F.col("n") == length).select("m")
        runs = windows.filter(starts_run()).select("id", *NODE, "s", "m")
        found.append(runs.join(own, "m", "left_semi").withColumn("n", F.lit(length)))
    places = reduce(DataFrame.union, found).groupBy("n", *NODE, "s").agg(F.min("id").alias("id"))
    # A list is as long as its text at most.
    return stored(places.groupBy("n", *NODE).agg(F.min("id").alias("id"), F.collect_list("s").alias("places")), "matched")


def around(runs: DataFrame, length: int) -> DataFrame:
    """From rows (node, words, s): the keys of the windows from s on, as far as a run may reach: node, s, n, k1, k2.

    Only the words near s leave the row; a text that matches throughout would otherwise be copied for each of its runs.
    """
    near = runs.select(*NODE, "s", F.slice("words", F.col("s") + 1, RUN_WINDOWS + length - 1).alias("near"))
    spread = near.select("*", F.explode(F.sequence(F.lit(0), F.size("near") - length)).alias("i"))
    key = window_key(F.slice("near", F.col("i") + 1, length), length)
    return spread.select(*NODE, (F.col("s") + F.col("i")).alias("s"), *key)


def extended_in_place(texts: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows around the fingerprints that texts share with items, which every task holds; no text is shuffled."""
    found = []
    for length in lengths:
        windows = least_grams(texts.select(*NODE, words_of(F.col("text")).alias("words")), length)
        own = F.broadcast(prints.filter(F.col("n") == length).select("m"))
        found.append(around(windows.filter(starts_run()).join(own, "m", "left_semi"), length))
    return reduce(DataFrame.union, found)


def extended_by_node(texts: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """The same with any number of fingerprints: texts with matches are looked up again by node."""
    matched, found = matched_runs(texts, prints, lengths), []
    for length in lengths:
        own = matched.filter(F.col("n") == length).drop("n")
        asked = own.select(*(F.col(c).alias(f"own_{c}") for c in own.columns))
        same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in [*NODE, "id"]]
        rows = texts.join(asked, reduce(Column.__and__, same))
        rows = rows.select(*NODE, words_of(F.col("text")).alias("words"), "own_places")
        found.append(around(rows.select(*NODE, "words", F.explode("own_places").alias("s")), length))
    return reduce(DataFrame.union, found)


def classes_of(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the class of every window, and the items of every class."""
    hashes = [F.bit_xor(h).alias(c) for h, c in zip(two_hashes("item"), CLASS, strict=True)]
    classed = stored(windows.select("item", *KEY).distinct().groupBy(*KEY).agg(*hashes), "classes")
    first = classed.groupBy(*CLASS).agg(F.min(F.struct(*KEY)).alias("first")).select(*CLASS, "first.*")
    return classed, stored(windows.select("item", *KEY).distinct().join(first, KEY).select(*CLASS, "item").distinct(), "class-items")


def hit_words(hits: DataFrame) -> DataFrame:
    """Per node, the words inside its windows; each window adds what those before it do not reach."""
    order = Window.partitionBy(*NODE).orderBy("s", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*NODE, "s", "n").distinct()
    reached = F.greatest(F.col("s"), F.coalesce(F.max(F.col("s") + F.col("n")).over(order), F.lit(0)))
    new = F.greatest(F.col("s") + F.col("n") - reached, F.lit(0))
    return spans.withColumn("new", new).groupBy(*NODE).agg(F.sum("new").cast("bigint").alias("n_hit"))


def hit_items(hits: DataFrame, class_items: DataFrame) -> DataFrame:
    """Per node, the number of its items and the digest of their sorted list."""
    own = stored(hits.select(*NODE, *CLASS).distinct(), "node-classes")
    marks = [F.bit_xor(h).alias(f"set{i}") for i, h in enumerate(two_hashes(*CLASS))]
    sets = stored(own.groupBy(*NODE).agg(F.count("*").alias("size"), *marks), "class-sets")
    kind = ["size", "set0", "set1"]
    first = sets.groupBy(*kind).agg(F.min(F.struct(*NODE)).alias("first")).select(*kind, "first.*")
    listed = first.join(own, NODE).join(class_items, CLASS).groupBy(*kind).agg(F.collect_set("item").alias("items"))
    digests = listed.select(
        *kind,
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    return sets.join(stored(digests, "item-lists"), kind).select(*NODE, "n_items", "items_sha256")


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated."""
    named = [h.alias(c) for h, c in zip(two_hashes(text), NODE, strict=True)]
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *named)
    windows, lengths = item_windows(items, item_key, item_text)
    rows = texts.select("id", *NODE, n_words(F.col("text")).alias("n_words"))
    if lengths:
        prints = stored(windows.select("n", "m").distinct(), "item-prints")
        classed, class_items = classes_of(windows)
        extended = extended_in_place if prints.count() <= BROADCAST_PRINTS else extended_by_node
        windows_of_texts = extended(texts, prints, lengths)
        hits = stored(windows_of_texts.join(classed, KEY).select(*NODE, "s", "n", *CLASS).distinct(), "hits")
        found = stored(hit_words(hits).join(hit_items(hits, class_items), NODE), "contaminated")
        rows = rows.join(found, NODE, "left")
    else:
        rows = rows.select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("n_hit", "n_items", "items_sha256")))
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select(
        F.col("id").alias(key),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce(F.col("items_sha256").cast("string"), F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
