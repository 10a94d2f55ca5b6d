"""Token counts of whole texts, huge ones by overlapping chunks.

The vocabulary drops white space and splits words at it, so the tokens of a text are those of the pieces between its
spaces; the counts of pieces are remembered, and the unknown pieces of a text are encoded in one call and told apart by
the offsets of their tokens.

Texts above `HUGE_CHARS` are encoded in chunks of `CHUNK_CHARS` that overlap. Two neighbouring chunks are spliced at a
boundary that is proven stable: a word starts there in both encodings, and the text cannot compose across it. A scan for
words looks only to the right, so from such a place both encodings go on as that of the whole text does, and what stands
before it is complete in the left chunk. If the overlap has no such place, it is doubled until it has one or the left
chunk is encoded anew together with the right one. Memory is bounded by a chunk unless a text has no stable place for
longer than that.

Special strings inside texts count as the library counts them by default. Null texts are empty and have no tokens; extra
columns are ignored; repeated rows and null ids are counted row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import Memo, once_per_worker

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
HUGE_CHARS = 65_536
LONG_PIECE = 64
LIMIT = 2_048


class Encoded:
    """Tokens of one stretch of text: ids, absolute start of each, and whether a word starts there."""

    def __init__(self, tokenizer, text: str, at: int, end: int):
        found = tokenizer.encode(text[at:end], add_special_tokens=False)
        self.ids = np.array(found.ids, np.int64)
        self.starts = np.array([s for s, _ in found.offsets], np.int64) + at
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        # Special strings have no word number; each is a word of its own.
        new = np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)] if len(words) else np.zeros(0, bool)
        self.word_starts = self.starts[new]


def stable(text: str, place: int) -> bool:
    """Whether nothing composes across this place."""
    return text[place - 1] < "\x80" and not unicodedata.combining(text[place])


def splice_place(text: str, left: Encoded, right: Encoded) -> int | None:
    """The last stable common boundary, but one: the last word of the left chunk may be cut off."""
    last = left.word_starts[-1] if len(left.word_starts) else 0
    common = np.intersect1d(left.word_starts[left.word_starts < last], right.word_starts)
    return next((int(p) for p in common[::-1] if p > 0 and stable(text, int(p))), None)


def encode_huge(
    tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> Iterator[np.ndarray]:
    """The ids of the whole text in order, part by part."""
    left_at, left_end = 0, min(chunk, len(text))
    left, keep_from = Encoded(tokenizer, text, left_at, left_end), 0
    while left_end < len(text):
        right_end, width, place, right = min(left_end + chunk - overlap, len(text)), overlap, None, None
        while place is None and left_end - width > max(left_at, keep_from):
            right = Encoded(tokenizer, text, left_end - width, right_end)
            place = splice_place(text, left, right)
            width *= 2
        if place is not None and place > keep_from:
            yield left.ids[(left.starts >= keep_from) & (left.starts < place)]
            left_at, left, keep_from = left_end - width // 2, right, place
        else:
            left = Encoded(tokenizer, text, left_at, right_end)
        left_end = right_end
    yield left.ids[left.starts >= keep_from]


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self._plain)

    def _plain(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        owner = np.searchsorted(ends, [s for s, _ in found.offsets], side="right")
        for piece, n in zip(pieces, np.bincount(owner, minlength=len(pieces)).tolist(), strict=True):
            self.memo.keep(piece, n)

    def count(self, text: str) -> int:
        if len(text) > HUGE_CHARS:
            return sum(len(ids) for ids in encode_huge(self.tokenizer, text))
        pieces = text.split(" ")
        unknown = [p for p in dict.fromkeys(pieces) if not self.memo.known(p)]
        short = [p for p in unknown if len(p) <= LONG_PIECE]
        if short:
            self._learn(short)
        if len(short) == len(unknown):
            return sum(map(self.memo.__getitem__, pieces))
        # Long pieces are not worth remembering.
        return sum(self.memo[p] if len(p) <= LONG_PIECE else self._plain(p) for p in pieces)


def n_tokens(text: Column, path: str) -> Column:
    @F.pandas_udf("bigint")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = once_per_worker(("token counter", path), lambda: Counter(path))
        for batch in texts:
            yield pd.Series([counter.count(t) if t else 0 for t in batch], dtype="int64")

    return counts(text)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, and over_limit."""
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    counted = docs.select(
        F.col(key).alias(key), n_bytes.alias("n_bytes"), n_tokens(F.col(text), tokenizer_path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
