"""A Merkle manifest of a table, stored in van Emde Boas layout.

Every row is a leaf, the SHA-256 of its fields. Per group, leaves in order of their key form a tree of arity three up to the
group's subroot; the subroots in order of their groups form another one up to the root. A run of fewer than three nodes is
hashed like a full one, also a single node, while its level has several.

Trees are cut into aligned blocks of `BLOCK_LEAVES` leaves, a power of three, so a group that holds a third of all rows is
many blocks. A task builds blocks one after the other, each as a byte string in van Emde Boas layout (see `veb`). The roots
of the blocks are the leaves of the next stage, until each group has one block; three stages hold 2.8e11 leaves per group.
On the way back, every stage reads the siblings of its leaves out of the stored blocks and hands each block's own path to
the stage below. A task holds one block and one batch of rows; nothing of a whole group or table meets in a task or in the
driver, which sees one number per stage.

Numbers of rows within groups come from a range partitioning by group and key, counts per partition and group, and prefix
sums over these counts.

Fields that are null are written as `-`, others as their UTF-8 byte count, a colon and the value. A null group is the first
one. Null keys come first in their group; equal keys are ordered by their leaves, so repeated rows are leaves of their own
and it does not matter which is which. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from . import veb

BLOCK_LEVELS = 8
BLOCK_LEAVES = veb.ARITY**BLOCK_LEVELS
DIGEST = 32
ABSENT = bytes(DIGEST)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(hashes: list[bytes]) -> bytes:
    """The hash of the hexadecimal texts of hashes."""
    return hashlib.sha256("".join(h.hex() for h in hashes).encode()).digest()


def row_hash(fields: list[Column]) -> Column:
    texts = [f.cast("string") for f in fields]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*marked), 256))


def levels_of(leaves: int) -> int:
    """Levels of the least tree that holds so many leaves."""
    levels, width = 1, 1
    while width < leaves:
        levels, width = levels + 1, width * veb.ARITY
    return levels


# A path from a node to the root: per step, the numbers of siblings to the left and right (a byte each) and their hashes.


def pack_path(steps: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    return b"".join(bytes((len(a), len(b))) + b"".join(a) + b"".join(b) for a, b in steps)


def unpack_path(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(path):
        n, m = path[at], path[at + 1]
        hashes = [path[i : i + DIGEST] for i in range(at + 2, at + 2 + (n + m) * DIGEST, DIGEST)]
        yield hashes[:n], hashes[n:]
        at += 2 + (n + m) * DIGEST


def proof_digest(path: bytes) -> bytes:
    return digest([h for a, b in unpack_path(path) for h in a + b])


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for left, right in unpack_path(path):
        leaf = digest([*left, leaf, *right])
    return leaf


class Stage(NamedTuple):
    """Written tables: leaves (group, number, total, block, hash, and what came with them) and blocks (group, block, total,
    n, root, nodes). `number` counts within the group and `total` is the group's leaves at this stage."""

    leaves: DataFrame
    blocks: DataFrame


class Manifest(NamedTuple):
    """Stages of the groups' trees and of the tree over their subroots."""

    groups: list[Stage]
    top: list[Stage]


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `number`, their place from 0 within `group` by `order`, and `total`, the rows of their group."""
    ranged = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    # After the sort, the lower bits of this id count the rows of a partition in order.
    placed = ranged.withColumn("part", F.spark_partition_id()).withColumn(
        "place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    )
    placed = stored(placed, "ordered")
    runs = placed.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    group = Window.partitionBy("group")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    offsets = stored(runs.select("group", "part", offset.alias("offset"), F.sum("n").over(group).alias("total")), "offsets")
    found = placed.join(offsets, ["group", "part"])
    return found.withColumn("number", F.col("place") + F.col("offset")).drop("part", "place", "offset")


def build_blocks(leaves: DataFrame) -> DataFrame:
    """Per (group, block): its root and its nodes. The only block of a group ends where one node remains."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, hashes = None, []

        def block() -> pd.DataFrame:
            levels = levels_of(len(hashes)) if name[2] <= BLOCK_LEAVES else BLOCK_LEVELS + 1
            places = veb.fill(levels, hashes, digest)
            nodes = b"".join(ABSENT if p is None else p for p in places)
            return pd.DataFrame(
                [(*name, len(hashes), places[0], nodes)], columns=["group", "block", "total", "n", "root", "nodes"]
            )

        for batch in batches:
            for *own, hash_ in zip(batch["group"], batch["block"], batch["total"], batch["hash"], strict=True):
                if own != name:
                    if hashes:
                        yield block()
                    name, hashes = own, []
                hashes.append(hash_)
        if hashes:
            yield block()

    together = leaves.select("group", "block", "total", "number", "hash").repartition("group", "block")
    ordered = together.sortWithinPartitions("group", "block", "number").select("group", "block", "total", "hash")
    return ordered.mapInPandas(build, "group string, block bigint, total bigint, n int, root binary, nodes binary")


def build_stages(leaves: DataFrame) -> list[Stage]:
    """The stages of the trees over numbered leaves (group, number, total, hash, ...)."""
    stages = []
    while True:
        leaves = stored(leaves.withColumn("block", F.expr(f"number div {BLOCK_LEAVES}")), "leaves")
        stages.append(Stage(leaves, stored(build_blocks(leaves), "blocks")))
        rest = stages[-1].blocks.filter(F.col("total") > BLOCK_LEAVES)
        if rest.isEmpty():
            return stages
        total = F.ceil(F.col("total") / BLOCK_LEAVES).cast("bigint").alias("total")
        leaves = rest.select("group", F.col("block").alias("number"), total, F.col("root").alias("hash"))


def last_blocks(stage: Stage) -> DataFrame:
    return stage.blocks.filter(F.col("total") <= BLOCK_LEAVES)


def build_manifest(
    rows: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = FIELDS,
    changed: Mapping[str, Column] | None = None,
) -> Manifest:
    """The trees over `rows`. Leaves carry `key` and, where `changed` gives other values for some of the fields, the hash
    of the row with these values as `changed`."""
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = [F.col(f) for f in fields]
    other = [(changed or {}).get(f, F.col(f)) for f in fields]
    leaves = rows.select(
        named.alias("group"), F.col(key).alias("key"), row_hash(own).alias("hash"), row_hash(other).alias("changed")
    )
    groups = build_stages(numbered(leaves, ["key", "hash"]))
    subroots = [last_blocks(s).select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("root").alias("hash")) for s in groups]
    return Manifest(groups, build_stages(numbered(reduce(DataFrame.union, subroots), ["key"])))


def stage_paths(stage: Stage, above: DataFrame, extra: list[str]) -> DataFrame:
    """Per leaf of a stage: group, number, hash, `extra`, its path joined to that of its block, subroot and root.

    `above` has (group, block, path, subroot, top). In every partition a block comes before its leaves.
    """
    blocks = stage.blocks.select("group", "block", "n", "nodes").join(above, ["group", "block"])
    # Numbers and keys travel as texts: a null among them would turn the others into floating-point numbers.
    columns = ["group", "number", "hash", *extra]
    leaves = stage.leaves.select("block", *(F.col(c).cast("string") if c in KEYS else F.col(c) for c in columns))
    rows = blocks.withColumn("number", F.lit(None).cast("string")).unionByName(leaves, allowMissingColumns=True)
    place = F.col("number").cast("bigint")
    ordered = rows.repartition("group", "block").sortWithinPartitions("group", "block", place.asc_nulls_first())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, places, above_block = 1, [], ()
        for batch in batches:
            found, own = [], []
            block_columns = (batch[c] for c in ("number", "nodes", "path", "subroot", "top"))
            for i, (number, nodes, *rest) in enumerate(zip(*block_columns, strict=True)):
                if number is None:
                    places = [nodes[at : at + DIGEST] for at in range(0, len(nodes), DIGEST)]
                    places = [None if p == ABSENT else p for p in places]
                    levels, above_block = veb.levels_of_size(len(places)), rest
                else:
                    path, subroot, top = above_block
                    steps = veb.siblings(places, levels, int(number) % BLOCK_LEAVES)
                    found.append((pack_path(steps) + path, subroot, top))
                    own.append(i)
            if own:
                made = pd.DataFrame(found, columns=["path", "subroot", "top"])
                yield pd.concat([batch[columns].iloc[own].reset_index(drop=True), made], axis=1)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*columns, "path", "subroot", "top"])
    asked = ordered.select(*columns, "nodes", "path", "subroot", "top")
    return asked.mapInPandas(read, schema).withColumn("number", F.col("number").cast("bigint"))


KEYS = ("number", "key")


def tree_paths(stages: list[Stage], ends: DataFrame | None, extra: list[str]) -> DataFrame:
    """Per leaf of the first stage its path, from the last stage down. `ends` has each group's (path, subroot, top); without
    it the paths end at the root of the only group."""
    paths = None
    for i, stage in reversed(list(enumerate(stages))):
        last = last_blocks(stage)
        if ends is None:
            above = last.select(
                "group", "block", F.lit(b"").alias("path"), F.col("root").alias("subroot"), F.col("root").alias("top")
            )
        else:
            above = last.select("group", "block").join(ends, "group").select("group", "block", "path", "subroot", "top")
        if paths is not None:
            above = above.union(paths.select("group", F.col("number").alias("block"), "path", "subroot", "top"))
        paths = stage_paths(stage, above, [] if i else extra)
        if i:
            paths = stored(paths, "paths")
    return paths


def proofs(manifest: Manifest) -> DataFrame:
    """Per row: key (as text), hash, changed, and the path, subroot and root (`top`) read from the stored blocks."""
    ends = tree_paths(manifest.top, None, ["key"])
    ends = ends.select(F.col("key").alias("group"), "path", F.col("hash").alias("subroot"), "top")
    return tree_paths(manifest.groups, stored(ends, "subroots"), ["key", "changed"])


@F.pandas_udf(T.StructType().add("proof", T.BinaryType()).add("folded", T.BinaryType()))
def followed(leaves: pd.Series, paths: pd.Series) -> pd.DataFrame:
    """The digest of the siblings on each path, and the root that leaf and path give."""
    pairs = zip(leaves, paths, strict=True)
    return pd.DataFrame([(proof_digest(p), fold(h, p)) for h, p in pairs], columns=["proof", "folded"])


def verify_rows(
    rows: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = FIELDS,
    changed: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per row: key, leaf, subroot, root and proof_sha256 of the rows as they are; folded_root from the row as `changed` has
    it and the siblings of the original; and whether that is the root."""
    found = proofs(build_manifest(rows, key, group, fields, changed)).withColumn("f", followed("changed", "path"))

    def text(hash_: str) -> Column:
        return F.lower(F.hex(hash_))

    return found.select(
        F.col("key").cast(rows.schema[key].dataType).alias(key),
        text("hash").alias("leaf"),
        text("subroot").alias("subroot"),
        text("top").alias("root"),
        text("f.proof").alias("proof_sha256"),
        text("f.folded").alias("folded_root"),
        (F.col("f.folded") == F.col("top")).alias("verified"),
    )
