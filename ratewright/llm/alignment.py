"""Alignment of two tokenizers by the byte places where tokens of both end.

Tokenizer A is a byte-level BPE and encodes a space and the text; B is a piece model that adds the space itself. Both token
sequences spell the same bytes, so their cumulative ends are compared: a dictionary from end to index is made for each, the
keys are intersected as hash sets, and the sorted common ends cut both id lists into groups. Every group ends with a token of
A and one of B that end together, its links. Neither vocabulary has tokens without bytes, except control tokens that are
never produced, so ends are distinct and a group has one link.

Both end a token in front of a single space between words (A by its pattern; B because no piece has a space after another
character, which is looked up), so texts are aligned word by word and the alignments of words are remembered. A text with a
word that does not stand alone is aligned as a whole.

A pair of ids counts as often as links of the whole table hold it. Rows write their links as packed (pair, times); pairs are
summed over the table. Rows and sums then meet by ranges of pairs: pairs are dealt into `BINS` bins by their hash, rows into
as many slices as keep all tasks of the session busy, and a task reads the sums of one bin and streams the rows of one
slice. So no task holds more than a bin of the sums and one batch of rows, and no pair is hot, since a row holds it once.

Null and empty texts have no tokens, and neither have texts whose bytes one of the tokenizers does not spell: zeros and an
empty string. Strings of special tokens are plain text. Repeated rows count as often as they stand there and get equal
results; a null id stays null. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .tokenizers_bytes import ByteEncoder
from .workers import Memo, once_per_worker

BINS = 8
MARK = "▁"
# Words whose alignment a worker remembers, and the longest of them.
REMEMBERED = 250_000
# Texts whose unknown words are aligned together.
LEARN_TEXTS = 256
LONG_PIECE = 64
SAFE_CUT = re.compile(r"(?<=[^ ])(?= \S)")


# Documents whose links travel in one row.
DEALT_DOCS = 1_024
# A pair is one unsigned number, its upper half the id of A; how often it occurs takes four bytes.
TIMES = "<u4"


def pair_type(pair_bytes: int) -> np.dtype:
    """Four bytes hold the pairs of vocabularies of up to 65,536 ids, eight any."""
    if pair_bytes not in (4, 8):
        raise ValueError("a pair takes 4 or 8 bytes")
    return np.dtype(f"<u{pair_bytes}")


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is printable, or the next free one
    from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(
        self, a_path: str, b_path: str, ranks_path: str | None = None, pattern: str | None = None, pair_bytes: int = 4
    ):
        import sentencepiece

        self.a = ByteEncoder(a_path, ranks_path, pattern, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.whole.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_lengths, self.b_lengths = ([len(t) for t in table] for table in (self.a_bytes, self.b_bytes))
        self.kind, self.shift = pair_type(pair_bytes), 4 * pair_bytes
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << self.shift:
            raise ValueError("the vocabularies have more ids than half a pair holds")
        # B cannot join tokens over a space that follows another character if no piece has one inside.
        self.cuts = all(MARK not in p.lstrip(MARK) for p in pieces)
        self.words = Memo(self._word, REMEMBERED)

    def _groups(self, text: str) -> Groups | None:
        """The groups of a space and the text; None where a tokenizer does not spell it."""
        whole = " " + text
        if self.a.fast is None:
            a = self.a.whole.encode(whole, add_special_tokens=False).ids
        else:
            a = self.a.fast.encode_ordinary(whole)
        b = self.b.encode(text, num_threads=1)
        spelled = whole.encode()
        if b"".join([self.a_bytes[i] for i in a]) != spelled or b"".join([self.b_bytes[i] for i in b]) != spelled:
            return None
        a_ends = dict(zip(accumulate([self.a_lengths[i] for i in a]), range(1, len(a) + 1), strict=True))
        b_ends = dict(zip(accumulate([self.b_lengths[i] for i in b]), range(1, len(b) + 1), strict=True))
        ends = sorted(a_ends.keys() & b_ends.keys())
        a_cuts, b_cuts = [a_ends[e] for e in ends], [b_ends[e] for e in ends]
        names, other = list(map(str, a)), list(map(str, b))
        texts, i, j = [], 0, 0
        for k, n in zip(a_cuts, b_cuts, strict=True):
            if k - i == 1 == n - j:
                texts.append(f"{names[i]}|{other[j]}")
            else:
                texts.append(f"{','.join(names[i:k])}|{','.join(other[j:n])}")
            i, j = k, n
        # The last tokens of a group end together.
        last_a, last_b = np.array(a, self.kind)[np.array(a_cuts) - 1], np.array(b, self.kind)[np.array(b_cuts) - 1]
        return ends, a_cuts, b_cuts, texts, last_a << self.kind.type(self.shift) | last_b

    def _aligned(self, text: str) -> Aligned | None:
        found = self._groups(text)
        if found is None:
            return None
        ends, a_cuts, b_cuts, texts, links = found
        return a_cuts[-1], b_cuts[-1], len(ends), ";".join(texts), links.tobytes()

    def learn(self, texts: Iterable[str | None]) -> None:
        """Aligns the unknown words of some texts as one text, which is cheaper than one by one."""
        if not self.cuts:
            return
        words = set().union(*(t.split(" ") for t in texts if t))
        unknown = [w for w in words if w and not self.words.known(w) and len(w) <= LONG_PIECE and not w[0].isspace()]
        found = self._groups(" ".join(unknown)) if unknown else None
        if found is None:  # a word is not spelled: each will be aligned on its own
            return
        ends, a_cuts, b_cuts, groups, links = found
        place = {end: i for i, end in enumerate(ends, 1)}
        at, i = 0, 0
        for word in unknown:
            at += len(word.encode()) + 1
            k = place[at]
            n_a, n_b = a_cuts[k - 1] - (a_cuts[i - 1] if i else 0), b_cuts[k - 1] - (b_cuts[i - 1] if i else 0)
            self.words.keep(word, (n_a, n_b, k - i, ";".join(groups[i:k]), links[i:k].tobytes()))
            i = k

    def _word(self, word: str) -> Aligned:
        if not word or word[0].isspace():
            raise _NotAlone
        found = self._aligned(word)
        if found is None:
            raise _NotAlone
        return found

    def parts(self, text: str | None) -> list[Aligned]:
        """The alignments of a text's words, or that of the whole text; none where a tokenizer does not spell it."""
        if not text:
            return []
        if self.cuts:
            try:
                return [self.words[w] if len(w) <= LONG_PIECE else self._word(w) for w in text.split(" ")]
            except _NotAlone:
                pass
            try:
                # The first stretch may begin with white space; the others begin with a space and another character.
                first, *rest = SAFE_CUT.split(text)
                own = self._aligned(first)
                if own is not None:
                    return [own, *(self.words[w[1:]] if len(w) <= LONG_PIECE else self._word(w[1:]) for w in rest)]
            except _NotAlone:
                pass
        own = self._aligned(text)
        return [] if own is None else [own]


# n_a, n_b, groups, their text, and the packed pairs of their links.
Aligned = tuple[int, int, int, str, bytes]
# Common ends, tokens of A and of B up to each, the texts of the groups, and the pairs of their links.
Groups = tuple[list[int], list[int], list[int], list[str], np.ndarray]


class _NotAlone(Exception):
    """A word that cannot be aligned on its own."""


def aligner(a_path: str, b_path: str, ranks_path: str | None, pattern: str | None, pair_bytes: int) -> Aligner:
    name = ("aligner", a_path, b_path, ranks_path, pair_bytes)
    return once_per_worker(name, lambda: Aligner(a_path, b_path, ranks_path, pattern, pair_bytes))


ALIGNED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())]
)


def aligned_rows(docs: DataFrame, key: str, text: str, paths: tuple, kind: np.dtype) -> DataFrame:
    """A written table: row, key, counts, the digest of the groups, and the packed links."""

    @F.pandas_udf(ALIGNED)
    def align(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = aligner(*paths, kind.itemsize)
        for batch in texts:
            found = []
            for i, text_ in enumerate(batch):
                if i % LEARN_TEXTS == 0:
                    own.learn(batch.iloc[i : i + LEARN_TEXTS])
                parts = own.parts(text_)
                n_a, n_b, n_groups, groups, links = zip(*parts, strict=True) if parts else [()] * 5
                digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if parts else ""
                pairs, times = np.unique(np.frombuffer(b"".join(links), kind), return_counts=True)
                packed = pairs.tobytes(), times.astype(TIMES).tobytes()
                found.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_groups), digest, *packed))
            yield pd.DataFrame(found, columns=ALIGNED.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), align(F.col(text)).alias("x"))
    return stored(rows.select("row", "key", "x.*"), "aligned")


def pair_counts(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """A written table per pair: links that hold it, and whether no pair of its B id has more."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch["pairs"]), kind)
            times = np.frombuffer(b"".join(batch["times"]), TIMES)
            known, place = np.unique(pairs, return_inverse=True)
            n = np.bincount(place, weights=times, minlength=len(known)).astype(np.int64)
            yield pd.DataFrame({"pair": known.astype(np.uint64).view(np.int64), "n": n})

    summed = rows.select("pairs", "times").mapInPandas(tally, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # A B id has at most one pair per id of A.
    own = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2 ** (4 * kind.itemsize) - 1)))
    return stored(summed.withColumn("best", F.col("n") == F.max("n").over(own)), "pair-counts")


def bin_of(pairs: np.ndarray) -> np.ndarray:
    """The bin of each pair; the upper bits of a product mix all bits of the pair."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BINS)


def dealt_rows(rows: DataFrame, slices: int, kind: np.dtype) -> DataFrame:
    """Links by bin, for up to `DEALT_DOCS` rows at a time: bin, slice, the rows, how many pairs each has in the bin, and
    their pairs and times."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), DEALT_DOCS):
                part = batch.iloc[at : at + DEALT_DOCS]
                row = part["row"].to_numpy(np.int64)
                owner = np.repeat(np.arange(len(row)), part["times"].map(len).to_numpy() // 4)
                pairs = np.frombuffer(b"".join(part["pairs"]), kind)
                times = np.frombuffer(b"".join(part["times"]), TIMES)
                bins, place, found = bin_of(pairs), int(row[0] // DEALT_DOCS % slices), []
                for k in range(BINS):
                    own = bins == k
                    sizes = np.bincount(owner[own], minlength=len(row)).astype(TIMES)
                    found.append((k, place, row.tobytes(), sizes.tobytes(), pairs[own].tobytes(), times[own].tobytes()))
                yield pd.DataFrame(found, columns=["bin", "slice", "rows", "sizes", "pairs", "times"])

    schema = "bin int, slice int, rows binary, sizes binary, pairs binary, times binary"
    return rows.select("row", "pairs", "times").mapInPandas(deal, schema)


def looked_up(dealt: DataFrame, counts: DataFrame, slices: int, kind: np.dtype) -> DataFrame:
    """Per row and bin: n_best and count_sum. In every partition the sums of a bin come before the links in it."""

    @F.pandas_udf("int")
    def bins(pairs: pd.Series) -> pd.Series:
        return pd.Series(bin_of(pairs.to_numpy(np.int64).view(np.uint64)).astype(np.int32))

    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    sums = counts.select(bins("pair").alias("bin"), "pair", "n", "best").withColumn("slice", every)
    both = sums.unionByName(dealt, allowMissingColumns=True)
    ordered = both.repartition("bin", "slice").sortWithinPartitions("bin", "slice", F.col("pair").asc_nulls_last())
    columns = ["bin", "slice", "pair", "n", "best", "rows", "sizes", "pairs", "times"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, ready, place = [], None, None
        for batch in batches:
            # Runs of sums and runs of links of the same bin and slice.
            is_sum = batch["rows"].isna().to_numpy()
            marks = np.c_[batch["bin"], batch["slice"], is_sum]
            edges = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1), len(batch) > 0])
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                run = batch.iloc[start:end]
                if (own := tuple(marks[start, :2])) != place:
                    parts, ready, place = [], None, own
                if is_sum[start]:
                    pair = run["pair"].to_numpy(np.int64).view(np.uint64).astype(kind)
                    parts.append((pair, run["n"].to_numpy(np.int64), run["best"].to_numpy(bool)))
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*parts, strict=True)]
                for rows, sizes, pairs, times in zip(run["rows"], run["sizes"], run["pairs"], run["times"], strict=True):
                    if pairs:
                        yield summed(ready, *(np.frombuffer(x, t) for x, t in ((rows, "<i8"), (sizes, TIMES), (pairs, kind), (times, TIMES))))

    def summed(known: list[np.ndarray], rows: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> pd.DataFrame:
        pair, n, best = known
        at, times = np.searchsorted(pair, pairs), times.astype(np.int64)
        ends = np.cumsum(sizes, dtype=np.int64)
        columns = {"row": rows}
        for name, values in (("n_best", times * best[at]), ("count_sum", times * n[at])):
            total = np.r_[0, np.cumsum(values)]
            columns[name] = total[ends] - total[ends - sizes]
        return pd.DataFrame(columns)

    return ordered.select(*columns).mapInPandas(look, "row bigint, n_best bigint, count_sum bigint")


def align_tokenizers(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    pair_bytes: int = 4,
) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind = pair_type(pair_bytes)
    rows = aligned_rows(docs, key, text, (a_path, b_path, ranks_path, pattern), kind)
    slices = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BINS)
    found = looked_up(dealt_rows(rows, slices, kind), pair_counts(rows, kind), slices, kind)
    sums = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = rows.select("row", F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("bigint")
    return kept.join(sums, "row", "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
