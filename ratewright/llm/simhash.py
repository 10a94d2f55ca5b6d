"""Near-duplicates by SimHash, found through an inverted index on byte positions.

A text is lower-cased (A to Z), split into words, and every four neighbouring words form a shingle. Bit b of the
fingerprint is set when more than half of the shingles' XXH64 values have it. Two fingerprints are linked at four or
fewer differing bits.

Four differing bits touch at most four of the eight bytes, so linked fingerprints share at least four bytes at the same
position (the guaranteed minimum of the count filter). Single bytes are poor keys: each of the 2,048 lists would hold a
256th of the corpus. Hence a list is kept per *three* positions and their bytes, for a family of 20 triples such that
any four positions contain one of them; no pair can be missed, and a list holds a 16-millionth of unrelated texts. Within
a list the shared positional bytes of a pair are tallied, pairs with fewer than four go, and the rest are verified bit by
bit.

Inside a list no pairs are written out: a search from member to member removes what it has reached, and one edge per
reached member leaves the task. Lists above `LIST_ROWS` are cut into blocks and every two blocks meet in a task of their
own. Exact copies, however many, are one fingerprint with its smallest id before anything is joined.

Null and empty texts, and texts of white space alone, have fingerprint zero and are linked like any other. Repeated rows
get the same result twice. A null id stays null and never is the smallest one; a group without any id has a null
component. Other columns are ignored. An empty table gives an empty result.

`near_duplicate_groups` is the contract of the query. `drop_near_duplicates`, the stage of the pipeline, keeps one row of
each of these groups: the one with the smallest id, a row without an id only where the group has no other, and any one of
several rows of that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path, stored
from .names import fresh

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
N_BYTES = 8
MIN_SHARED = N_BYTES - MAX_BITS
LIST_ROWS = 4_096


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The XXH64 values of a text's shingles, in order; fewer words than a shingle has are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - words_per_shingle + 1)
    if n == 1:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count=n)


def fingerprint_of(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number."""
    hashes = shingle_hashes(text, words_per_shingle)
    n = len(hashes)
    if not n:
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint as a signed number with the same bits."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint_of(t) for t in batch], np.uint64).view(np.int64))


def covering_triples() -> list[tuple[int, ...]]:
    """Triples of byte positions such that any four of the eight positions contain one.

    The positions are dealt into three groups in a cycle; a triple counts if it lies in one group, or has two positions in
    a group and one in the next.
    """
    group = [p % 3 for p in range(N_BYTES)]

    def counts(triple: tuple[int, ...]) -> bool:
        sizes = [sum(group[p] == g for p in triple) for g in range(3)]
        return 3 in sizes or any(sizes[g] == 2 and sizes[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(N_BYTES), 3) if counts(t)]


def postings(nodes: DataFrame, fp: str) -> DataFrame:
    """One row per fingerprint and triple: the list it belongs to."""

    def byte(position: int):
        return F.shiftrightunsigned(F.col(fp), 8 * position).bitwiseAND(255)

    keys = [
        F.lit(i << 24).cast("bigint")
        + F.shiftleft(byte(a), 16)
        + F.shiftleft(byte(b), 8)
        + byte(c)
        for i, (a, b, c) in enumerate(covering_triples())
    ]
    return nodes.select(F.explode(F.array(*keys)).alias("list"), F.col(fp).alias("fp"))


def _reached(members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of members (positions) that links connect, each as its first member and the others."""
    values = members.view(np.uint64)
    octets = values.view(np.uint8).reshape(-1, N_BYTES)
    open_ = np.arange(len(values))
    while len(open_):
        first, open_ = open_[0], open_[1:]
        frontier, found = [first], []
        while frontier and len(open_):
            at = frontier.pop()
            shared = (octets[open_] == octets[at]).sum(axis=1)
            near = shared >= MIN_SHARED
            near[near] = np.bitwise_count(values[open_[near]] ^ values[at]) <= MAX_BITS
            reached = open_[near]
            open_ = open_[~near]
            frontier.extend(reached.tolist())
            found.append(reached)
        if found:
            yield first, np.concatenate(found)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges within each list; rows arrive sorted by list, and a list may run over several batches."""
    left = pd.DataFrame({"list": [], "low": [], "high": [], "fp": []}, dtype="int64")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[["list", "low", "high"]].to_numpy()
        fps = rows["fp"].to_numpy()
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        a, b = [], []
        for start, end in zip(new[:-1], new[1:], strict=True):
            if end - start > 1:
                members = np.unique(fps[start:end])
                for first, others in _reached(members):
                    b.append(members[others])
                    a.append(np.full(len(others), members[first]))
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    for batch in batches:
        rows = pd.concat([left, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[["list", "low", "high"]] == rows[["list", "low", "high"]].iloc[-1]).all(axis=1).to_numpy()
        # Rows are sorted, so the last list is a run at the end; it waits for the next batch.
        cut = len(rows) - int(last[::-1].cumprod().sum())
        if cut:
            yield work(rows.iloc[:cut])
        left = rows.iloc[cut:]
    if len(left):
        yield work(left)


def link_fingerprints(nodes: DataFrame, fp: str = "fp", list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `nodes.fp` exactly as all links at MAX_BITS would."""
    lists = postings(nodes, fp)
    long = lists.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > list_rows)
    blocks = F.coalesce(F.ceil(F.col("n") / list_rows), F.lit(1)).cast("bigint")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = (
        lists.join(long, "list", "left")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    sorted_lists = dealt.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    return sorted_lists.mapInPandas(_edges, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components as stars: (node, root) for every node but the roots.

    Large-star and small-star steps in turn: each hangs the neighbours of a node on the smallest of them. Every round is
    written to the shared folder. Nodes are distinct fingerprints, so a node has as many neighbours as there are different
    fingerprints near it, not as there are copies.
    """
    spark = edges.sparkSession

    def smallest(links: DataFrame) -> DataFrame:
        least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return links.join(least, "u")

    def large_star(links: DataFrame) -> DataFrame:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(links: DataFrame) -> DataFrame:
        hung = smallest(links)
        others = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return others.union(hung.select("u", F.col("m").alias("v"))).distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links, before = stored(ordered.distinct(), "links"), None
    while (now := mark(links)) != before:
        before = now
        path = fresh_path(spark, "links")
        small_star(large_star(links).filter("u <> v").distinct()).write.parquet(path)
        links = spark.read.parquet(path)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def component_table(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """From stored (id, fp) rows, one line per distinct fingerprint: fp and component_id, its group's smallest id."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    stars = components(link_fingerprints(nodes, list_rows=list_rows))
    rooted = nodes.join(stars, F.col("fp") == F.col("node"), "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return stored(rooted.join(least, "root").select("fp", "component_id"), "components")


def near_duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", list_rows: int = LIST_ROWS
) -> DataFrame:
    """Per row of `docs`: its id, fingerprint (16 hex digits) and component_id, the smallest id of its group."""
    prints = stored(docs.select(F.col(key).alias("id"), fingerprint(F.col(text)).alias("fp")), "prints")
    found = component_table(prints, list_rows)
    # Both sides are plain scans, so adaptive execution can split the fingerprint that thousands of copies share.
    return prints.join(found, "fp").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", list_rows: int = LIST_ROWS
) -> DataFrame:
    """`docs` with one row of each group of linked fingerprints, the one with the smallest id."""
    fp, row, winner = fresh(docs, "fp", "row", "winner")
    marked = stored(docs.withColumns({fp: fingerprint(F.col(text)), row: F.monotonically_increasing_id()}), "marked")
    # Ids are compared as structs: rows without one last, and a row number decides between equals.
    order = F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("id"), F.col(row).alias("row"))
    groups = component_table(marked.select(order.alias("id"), F.col(fp).alias("fp")), list_rows)
    kept = groups.select(F.col("component_id.row").alias(winner)).distinct()
    # Winners grow with the documents, so they are never broadcast; hashing them leaves the texts unsorted.
    return marked.join(kept.hint("shuffle_hash"), F.col(row) == F.col(winner), "left_semi").select(*docs.columns)
