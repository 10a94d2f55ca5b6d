"""Packing of documents into sequences by a grouping genetic algorithm on islands.

Texts become token ids and an end id. A longer document is cut so that all its pieces but the first are full. Full pieces
are sequences by themselves. The others are dealt at random into blocks of about `BLOCK_PIECES` pieces. Each block is
evolved on several islands, each with a population of its own; between epochs every island receives the elite of its
neighbour. The best packing of a block over its islands counts. What the emptiest sequences of all blocks hold is then
dealt into new blocks and packed once more, so that blocks leave few half-empty sequences behind.

A piece is known by a number of its own from the table it is first written to, so null or repeated ids do no harm: every
row is packed. Null and empty texts are the end id alone. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .genetic import Packing, evolve, fill, first_packings, fitness
from .tokenizers_bytes import ID_BYTES, byte_encoder

CAPACITY = 1_024
END_ID = 2
BLOCK_PIECES = 2_048
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 3

PIECES = "array<struct<start: bigint, length: bigint, ids_crc32: bigint>>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(text: Column, path: str, ranks_path: str | None, pattern: str | None, capacity: int) -> Column:
    """The pieces of each text."""

    @F.pandas_udf(PIECES)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = byte_encoder(path, ranks_path, pattern)
        end = END_ID.to_bytes(ID_BYTES, "little")

        def of(text: str | None) -> list[dict]:
            ids = encoder.encode(text or "") + end
            return [
                {"start": s, "length": n, "ids_crc32": zlib.crc32(ids[s * ID_BYTES : (s + n) * ID_BYTES])}
                for s, n in cut(len(ids) // ID_BYTES, capacity)
            ]

        for batch in texts:
            yield pd.Series([of(t) for t in batch])

    return pieces(text)


def _evolve(capacity: int, generations: int, population: int):
    """Population after an epoch, best first, from sizes, the population so far (or none), and a seed."""

    @F.pandas_udf("array<array<array<int>>>")
    def run(blocks: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, before, seeds in blocks:
            out = []
            for own, known, seed in zip(sizes, before, seeds, strict=True):
                chance, own = random.Random(int(seed)), [int(s) for s in own]
                found: list[Packing] = [[[int(i) for i in b] for b in p] for p in (known if known is not None else [])]
                out.append(
                    evolve(found or first_packings(own, capacity, population, chance), own, capacity, generations, chance)
                )
            yield pd.Series(out)

    return run


def _rated(capacity: int):
    """Bins and fitness of the best packing."""

    @F.pandas_udf("bins bigint, fit double")
    def rate(blocks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sizes, populations in blocks:
            rows = [(len(p[0]), fitness(p[0], s, capacity)) for s, p in zip(sizes, populations, strict=True)]
            yield pd.DataFrame(rows, columns=["bins", "fit"])

    return rate


def _placed(capacity: int):
    """Per piece of a packing, by its number in the block: bin, offset, and the tokens in its bin."""

    @F.pandas_udf("array<struct<bin: int, place: bigint, filled: bigint>>")
    def place(sizes: pd.Series, packings: pd.Series) -> pd.Series:
        out = []
        for own, packing in zip(sizes, packings, strict=True):
            rows = [None] * len(own)
            for k, b in enumerate(packing):
                at, total = 0, int(fill(b, own))
                for i in b:
                    rows[i] = {"bin": k, "place": at, "filled": total}
                    at += int(own[i])
            out.append(rows)
        return pd.Series(out)

    return place


def pack_blocks(
    pieces: DataFrame,
    n_blocks: int,
    capacity: int = CAPACITY,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    seed: int = 1,
) -> DataFrame:
    """Bins for `pieces` (number, length): number, block, bin, place, filled. Blocks are dealt by hash, so their size is
    bounded by `BLOCK_PIECES` and chance."""
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(n_blocks)))
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("number", "length"))).alias("items"))
    start = blocks.select(
        "block",
        F.col("items.number").alias("numbers"),
        F.col("items.length").alias("sizes"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
    ).withColumn("population", F.lit(None).cast("array<array<array<int>>>"))
    epoch = _evolve(capacity, generations, population)
    state = start
    for e in range(epochs):
        own_seed = F.xxhash64(F.lit(seed), F.lit(e), "block", "island")
        state = stored(state.withColumn("population", epoch("sizes", "population", own_seed)), "islands")
        if e < epochs - 1:
            elites = state.select(
                "block", ((F.col("island") + 1) % islands).alias("island"), F.slice("population", 1, 1).alias("elite")
            )
            # The newcomer takes the place of the weakest.
            keeps = F.slice("population", 1, F.greatest(F.size("population") - 1, F.lit(1)))
            state = state.join(elites, ["block", "island"]).withColumn("population", F.concat("elite", keeps)).drop("elite")
    rated = state.withColumn("rating", _rated(capacity)("sizes", "population"))
    best = rated.groupBy("block").agg(
        F.min_by(
            F.struct("numbers", "sizes", F.col("population")[0].alias("packing")),
            F.struct("rating.bins", -F.col("rating.fit"), "island"),
        ).alias("best")
    )
    placed = best.select(
        "block", F.explode(F.arrays_zip("best.numbers", _placed(capacity)("best.sizes", "best.packing"))).alias("p")
    )
    found = placed.select("block", F.col("p")["numbers"].alias("number"), F.col("p")["1"].alias("at"))
    return found.select("number", "block", "at.bin", "at.place", "at.filled")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = docs.select(
        F.col(key).alias("id"),
        F.posexplode(token_pieces(F.col(text), tokenizer_path, ranks_path, pattern, capacity)).alias("piece", "p"),
    )
    pieces = stored(
        cut_up.select("id", "piece", "p.*", F.monotonically_increasing_id().alias("number")), "pieces"
    )
    loose = pieces.filter(F.col("length") < capacity).select("number", "length")
    n_blocks = max(1, -(-loose.count() // block_pieces))
    first = stored(pack_blocks(loose, n_blocks, capacity), "first-packing")

    # Sequences filled below the usual level are dealt again, over all blocks.
    again = first.filter(F.col("filled") < 0.97 * capacity)
    sizes = loose.join(again.select("number"), "number", "left_semi")
    n_again = max(1, -(-again.count() // block_pieces))
    second = pack_blocks(sizes, n_again, capacity, seed=2)

    def numbered(packed: DataFrame, turn: int) -> DataFrame:
        # Blocks of both turns and bins within them in one number.
        sequence = (F.col("block").cast("bigint") * 2 + turn) * F.lit(2**24) + F.col("bin")
        return packed.select(F.col("number"), sequence.alias("sequence_id"), F.col("place").alias("offset"))

    full = pieces.filter(F.col("length") == capacity).select(
        "number", (-F.col("number") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    stay = numbered(first.filter(F.col("filled") >= 0.97 * capacity), 0)
    places = stay.unionByName(numbered(second, 1)).unionByName(full)
    return pieces.join(places, "number").select(
        F.col("id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
