"""Packed token ids in binary form.

Every task encodes its texts, cuts those above the capacity into pieces without losing an id, and packs windows of pieces
by best-fit decreasing: pieces from long to short, each into the open sequence that it fills best, which a segment tree
over the free capacities finds. A piece that fills a sequence leaves at once, and so do sequences filled well. The pieces
of the others move on to the next window, as far as they fill half of it; beyond that the fullest sequences leave. So
every round of packing frees half a window: a task holds one window and the ids of one text, and its time grows with the
ids. Nothing is shuffled.

A row is one sequence: `input_ids`, a fixed-length row of little-endian 32-bit ids filled up with the pad id;
`cu_seqlens`, the cumulative lengths of its segments from 0; `position_ids`, little-endian 16-bit positions that restart
in every segment; and the id, piece and start of each segment's document.

Null and empty texts are the end id alone. Null ids stay null; repeated rows are packed as often as they stand there.
Other columns are ignored. An empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import CAPACITY, END_ID, cut
from .tokenizers_bytes import ID_BYTES, byte_encoder

WINDOW_PIECES = 4_096
WELL_FILLED = 0.98
OUTPUT_ROWS = 512
PAD_ID = 0


class CapacityTree:
    """Counts of open sequences by free capacity, with the smallest sufficient capacity found from the root down."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        node = free + self.leaves
        while node:
            self.counts[node] += n
            node //= 2

    def smallest(self, need: int) -> int | None:
        """The smallest free capacity of at least `need`."""
        node = need + self.leaves
        if self.counts[node]:
            return need
        # Up to the first right sibling that holds something, then down to its leftmost filled leaf.
        while node > 1:
            if node % 2 == 0 and self.counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of item numbers."""
    tree, open_ = CapacityTree(capacity), {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free = tree.smallest(lengths[item])
        if free is None:
            items, free = [item], capacity
        else:
            items = open_[free].pop()
            items.append(item)
            tree.add(free, -1)
        free -= lengths[item]
        open_.setdefault(free, []).append(items)
        tree.add(free, 1)
    return [items for stack in open_.values() for items in stack]


def sequences(pieces: Iterable[tuple], capacity: int, window: int) -> Iterator[list[tuple]]:
    """Pieces, whose last field is their ids, as sequences of them; at most `window` pieces wait."""
    waiting: list[tuple] = []

    def packed(stay: int) -> Iterator[list[tuple]]:
        nonlocal waiting
        lengths = [len(p[-1]) // ID_BYTES for p in waiting]
        bins = [(sum(lengths[i] for i in items), items) for items in best_fit_decreasing(lengths, capacity)]
        here, own, waiting = len(waiting), waiting, []
        for filled, items in sorted(bins, key=lambda b: -b[0]):
            if here > stay or filled >= WELL_FILLED * capacity:
                here -= len(items)
                yield [own[i] for i in items]
            else:
                waiting += [own[i] for i in items]

    for piece in pieces:
        if len(piece[-1]) == capacity * ID_BYTES:
            yield [piece]
            continue
        waiting.append(piece)
        if len(waiting) >= window:
            yield from packed(window // 2)
    yield from packed(0)


def pack_ids(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    window: int = WINDOW_PIECES,
) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, input_ids, cu_seqlens, position_ids, segments."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(tokenizer_path, ranks_path, pattern)
        end = END_ID.to_bytes(ID_BYTES, "little")
        pad = PAD_ID.to_bytes(ID_BYTES, "little")
        positions = np.arange(capacity, dtype="<u2").tobytes()
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for key_, text_ in batch.itertuples(index=False, name=None):
                    ids = encoder.encode(text_ or "") + end
                    for piece, (s, n) in enumerate(cut(len(ids) // ID_BYTES, capacity)):
                        yield key_, piece, s, ids[s * ID_BYTES : (s + n) * ID_BYTES]

        def row(number: int, own: list[tuple]) -> tuple:
            lengths = [len(p[3]) // ID_BYTES for p in own]
            total = sum(lengths)
            ids = b"".join(p[3] for p in own) + pad * (capacity - total)
            places = b"".join(positions[: 2 * n] for n in lengths) + b"\0\0" * (capacity - total)
            segments = [{"id": p[0], "piece": p[1], "start": p[2]} for p in own]
            return number, total, ids, [0, *np.cumsum(lengths).tolist()], places, segments

        rows = (row(n, own) for n, own in enumerate(sequences(pieces(), capacity, window), first))
        while some := list(islice(rows, OUTPUT_ROWS)):
            yield pd.DataFrame(some, columns=COLUMNS)

    # Ids travel as texts, so that null ones do not turn the others into floating-point numbers.
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    packed = rows.mapInPandas(
        pack,
        "sequence_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
        "segments array<struct<id: string, piece: int, start: bigint>>",
    )
    kind = docs.schema[key].dataType.simpleString()
    return packed.withColumn("segments", F.col("segments").cast(f"array<struct<id: {kind}, piece: int, start: bigint>>"))


COLUMNS = ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "segments"]


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the sequences as Parquet, a fixed-length row of ids each."""
    packed.write.parquet(path)
