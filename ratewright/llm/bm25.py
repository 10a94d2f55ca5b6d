"""Exact top-k search by BM25 over a sharded inverted index with block-max pruning.

Documents are dealt once over shards by the hash of their id and text. A task indexes its shard once and reads the queries
against it from the shared folder, block by block, so neither documents nor queries are written again for the other, and its
memory is bounded by a shard and a block. Shards are counted by documents and postings; rows that repeat beyond twice a
shard make a further index of the same task. All statistics are global: number of documents, mean
length and document frequencies over the whole table. A shard orders its documents by length, as the impact of a term
depends on it, and keeps postings by term. Terms in more than one of `COMMON_SHARE` documents of the shard also have the
largest impact per run of `BLOCK_DOCS` documents; those in more than one of `MIDDLE_SHARE` are middle terms, whose impacts
stand in a matrix (both together are the `MATRIX_TERMS` most frequent at most, the others count as rare).

About the square root of all shards are searched first. The k-th best score that a query has there is its floor in the other
shards: no document below it can be among the best k, so it is neither scored nor returned there.

The pivot test of WAND is made for all documents of a shard at once: the upper bound of a document is what the query's
rare terms give it, taken from their postings, plus the impacts of its middle terms in single precision, with a margin for
the rounding, plus the block maxima of the query's common terms, whose long postings are never read. Documents that the
maxima leave are bounded again by their own impacts of common terms. Documents whose bound reaches the floor are scored in
the order of their bounds, in steps that double, and the search ends when no bound reaches the k-th score so far, so every
document left out provably stays below it. The best k of each shard are merged into the best k overall. Scores are rounded
to nine decimals, so that sums made in another order tie; ties go to the smaller id.

Terms are lower-cased words (A to Z; words end at ASCII white space), known by 64-bit hashes. Queries are bags of terms:
a term counts as often as the query has it. A query without a term that occurs finds nothing; documents that share no
term are no hits. Null texts are empty. Null ids cannot be named in a result: such documents count in the statistics and
are no hits, and such queries give no rows. Documents that repeat are hits of their own. Queries of one id but other texts
are told apart by `query_text`, a hash of the text, and have their own k hits; equal ones are asked once. Extra columns are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path, stored
from .workers import stored_batches

K1, B = 1.2, 0.75
TOP_K = 10
BLOCK_DOCS = 4
COMMON_SHARE, MIDDLE_SHARE, MATRIX_TERMS = 8, 24, 2_048
SHARD_DOCS, SHARD_POSTINGS = 8_192, 3_000_000
QUERY_BLOCK = 256
# Queries in a file, and about the bytes that a reader of it holds at once.
FILE_QUERIES, FILE_BYTES = 16_384, 4 * 2**20
FIRST_STEP = 16
DECIMALS, SLACK = 9, 1e-8

BAG = T.StructType(
    [
        T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
        T.StructField("length", T.LongType()),
    ]
)


@F.pandas_udf(BAG)
def bag_of_terms(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            counts = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
            terms = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, count=len(counts)).view(np.int64)
            rows.append((terms, np.fromiter(counts.values(), np.int32, count=len(counts)), counts.total()))
        yield pd.DataFrame(rows, columns=["terms", "tfs", "length"])


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first[i], ..., first[i] + sizes[i] - 1 of every i, one after the other."""
    before = np.cumsum(sizes) - sizes
    places = np.repeat(first - before, sizes)
    places += np.arange(len(places))
    return places


def numbers_of(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The size of each list, and the numbers of all lists one after the other."""
    whole = lists.combine_chunks()
    sizes = pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, whole.flatten().to_numpy(zero_copy_only=False)


def pieces(batches: Iterator[pa.RecordBatch], docs: int, postings: int) -> Iterator[pa.Table]:
    """The rows of all batches in tables of at most so many documents and postings; a longer document is alone."""
    held, n, total = [], 0, 0
    for batch in batches:
        start = 0
        for i, size in enumerate(pc.list_value_length(batch["terms"]).to_pylist()):
            if n and (n == docs or total + size > postings):
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, n, total, start = [], 0, 0, i
            n, total = n + 1, total + size
        held.append(batch.slice(start))
    if n:
        yield pa.Table.from_batches(held)


class Shard:
    """The index of one shard: impacts by term, and block maxima and document lists of common terms. The inverse document
    frequency is the query's part, as it is the same for all documents."""

    def __init__(self, docs: pa.Table, mean_length: float):
        docs = docs.sort_by([("length", "ascending"), ("id", "ascending")])
        self.ids = docs["id"].to_numpy().astype(np.int64)
        n_docs = len(docs)
        sizes, terms = numbers_of(docs["terms"])
        tf = numbers_of(docs["tfs"])[1].astype(float)
        owner = np.repeat(np.arange(n_docs), sizes)
        norm = K1 * (1 - B + B * docs["length"].to_numpy().astype(float) / max(mean_length, 1e-9))
        impact = tf * (K1 + 1) / (tf + norm[owner])
        # By term; the sort is stable, so documents rise within each.
        order = np.argsort(terms, kind="stable")
        by_term = terms[order]
        new = np.r_[True, by_term[1:] != by_term[:-1]][: len(by_term)]
        self.terms, self.first = by_term[new], np.flatnonzero(new)
        self.df = np.diff(np.r_[self.first, len(by_term)])
        self.owner, self.impact = owner[order], impact[order]
        # The common terms, then the middle ones.
        frequent = np.argsort(-self.df, kind="stable")[:MATRIX_TERMS]
        frequent = frequent[self.df[frequent] * MIDDLE_SHARE > n_docs]
        self.n_common = int((self.df[frequent] * COMMON_SHARE > n_docs).sum())
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        places = spans(self.first[frequent], self.df[frequent])
        row, doc, own = np.repeat(np.arange(len(frequent)), self.df[frequent]), self.owner[places], self.impact[places]
        self.impacts = np.zeros((len(frequent), n_docs), np.float32)
        self.impacts[row, doc] = own
        ends = np.arange(0, n_docs, BLOCK_DOCS)
        self.maxima = np.maximum.reduceat(self.impacts[: self.n_common], ends, axis=1)
        self.of_doc = np.ascontiguousarray(self.impacts[: self.n_common].T)
        self.impacts = self.impacts[self.n_common :]
        # Single precision errs by less than this share in a sum of so many terms, none of them negative.
        self.above = np.float32(1 + (len(frequent) + 8) * 2.0**-23)
        # The frequent terms of each document, in the order of its text.
        by_doc = np.argsort(order[places])
        self.frequent_row, self.frequent_impact = row[by_doc], own[by_doc]
        self.frequent_size = np.bincount(doc, minlength=n_docs)
        self.frequent_start = np.cumsum(self.frequent_size) - self.frequent_size

    def search(self, queries: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The place of each query that has hits, with the ids and scores of its best k that reach its floor."""
        if not len(self.terms):
            return
        sizes, terms = numbers_of(queries["terms"])
        at = np.searchsorted(self.terms, terms)
        found = self.terms[np.minimum(at, len(self.terms) - 1)] == terms
        asker, at = np.repeat(np.arange(len(sizes)), sizes)[found], at[found]
        weights = numbers_of(queries["weights"])[1][found]
        row = self.row[at]
        rare = row < 0
        frequent = np.zeros((len(sizes), self.n_common + len(self.impacts)))
        frequent[asker[~rare], row[~rare]] = weights[~rare]
        single = frequent.astype(np.float32)
        maxima = single[:, : self.n_common] @ self.maxima * self.above
        middle = single[:, self.n_common :] @ self.impacts * self.above
        at, weights = at[rare], weights[rare]
        edges = np.searchsorted(asker[rare], np.arange(len(sizes) + 1))
        for q, floor in enumerate(queries["floor"].to_pylist()):
            own = slice(edges[q], edges[q + 1])
            ids, scores = self._best(self._rare_part(at[own], weights[own]), middle[q], maxima[q], frequent[q], k, floor)
            if len(ids):
                yield q, ids, scores

    def _best(
        self, rare: np.ndarray, middle: np.ndarray, maxima: np.ndarray, frequent: np.ndarray, k: int, floor: float
    ) -> tuple[np.ndarray, np.ndarray]:
        part = rare + middle
        bound = part + np.repeat(maxima, BLOCK_DOCS)[: len(rare)]

        def reach(docs: np.ndarray, least: float) -> np.ndarray:
            # Bounds are sums in another order than scores are; the slack keeps rounding from pruning a tie.
            return docs[bound[docs] * (1 + SLACK) + SLACK >= least]

        def tightened(docs: np.ndarray, least: float) -> np.ndarray:
            # What the block maxima leave is bounded by the documents' own impacts.
            own = np.einsum("dt,t->d", self.of_doc[docs], frequent[: self.n_common].astype(np.float32))
            bound[docs] = part[docs] + own * self.above
            return reach(docs, least)

        best, scores = np.zeros(0, np.int64), np.zeros(0)
        rest = reach(np.flatnonzero(bound > 0), floor)
        if floor > 0:
            rest = tightened(rest, floor)
        # The first step takes the largest bounds unsorted; only what its k-th score cannot rule out is ever sorted.
        step = FIRST_STEP
        order = np.argpartition(-bound[rest], step - 1) if len(rest) > step else np.arange(len(rest))
        group, rest = rest[order[:step]], rest[order[step:]]
        while len(group):
            found = rare[group] + self._frequent_part(group, frequent)
            rounded = np.round(found, DECIMALS)
            hit = (found > 0) & (rounded >= floor)
            scores, best = np.concatenate([scores, rounded[hit]]), np.concatenate([best, group[hit]])
            top = np.lexsort((self.ids[best], -scores))[:k]
            scores, best = scores[top], best[top]
            if len(best) == k:
                rest = reach(rest, scores[-1])
            if step == FIRST_STEP:
                rest = rest if floor > 0 else tightened(rest, scores[-1] if len(best) == k else 0.0)
                rest = rest[np.argsort(-bound[rest], kind="stable")]
            step *= 2
            group, rest = rest[:step], rest[step:]
        return self.ids[best], scores

    def _rare_part(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What these terms give every document."""
        df = self.df[at]
        places = spans(self.first[at], df)
        gains = np.repeat(weights, df)
        gains *= self.impact[places]
        return np.bincount(self.owner[places], gains, minlength=len(self.ids))

    def _frequent_part(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What common and middle terms give some documents; `weights` has one number per such term."""
        sizes = self.frequent_size[docs]
        places = spans(self.frequent_start[docs], sizes)
        gains = weights[self.frequent_row[places]] * self.frequent_impact[places]
        return np.bincount(np.repeat(np.arange(len(docs)), sizes), gains, minlength=len(docs))


def search(
    docs: DataFrame,
    queries: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = TOP_K,
    shard_docs: int = SHARD_DOCS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Per query and rank (from 1): query_id, query_text, rank, id, score. `queries` has the same two columns as `docs`; ids
    are whole numbers."""
    bags = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("place"), bag_of_terms(text).alias("bag"))
    counted = bags.select(F.explode(F.arrays_zip("bag.terms", "bag.tfs")).alias("p")).select("p.*")
    terms = stored(counted.groupBy("terms").agg(F.count("*").alias("df"), F.sum("tfs").alias("n")), "terms")
    n_docs = docs.count()
    totals = terms.agg(F.sum("n").alias("words"), F.sum("df").alias("postings")).first()
    mean_length = (totals.words or 0) / max(1, n_docs)
    n_shards = max(1, -(-n_docs // shard_docs), -(-(totals.postings or 0) // SHARD_POSTINGS))
    n_first = math.isqrt(n_shards - 1) + 1

    named = queries.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.xxhash64(text).alias("query_text"), F.col(text).alias("text")
    )
    asked = named.dropDuplicates(["id", "query_text"]).select("id", "query_text", bag_of_terms("text").alias("bag"))
    name = ["id", "query_text"]
    pairs = asked.select(*name, F.explode(F.arrays_zip("bag.terms", "bag.tfs")).alias("p")).select(*name, "p.*")
    weight = F.col("tfs") * F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = pairs.join(terms, "terms")
    asked = stored(
        weighed.groupBy(*name)
        .agg(F.sort_array(F.collect_list(F.struct("terms", weight.alias("weight")))).alias("list"))
        .select(*name, F.col("list.terms").alias("terms"), F.col("list.weight").alias("weights")),
        "queries",
    )
    n_files = max(1, -(-asked.count() // FILE_QUERIES))

    def hits(first: bool, asked: DataFrame) -> DataFrame:
        """What the queries, with their floors, find in the first shards or in the others."""
        path = fresh_path(asked.sparkSession, "queries")
        asked.repartition(n_files).write.option("parquet.block.size", FILE_BYTES).parquet(path)
        files = asked.sparkSession.read.parquet(path).inputFiles()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, 2 * shard_docs, 2 * SHARD_POSTINGS):
                index = Shard(piece, mean_length)
                for block in stored_batches(files, query_block):
                    found = list(index.search(block, k))
                    if found:
                        places, ids, scores = zip(*found, strict=True)
                        asker = np.repeat(places, list(map(len, ids)))
                        whose = [block[c].to_numpy()[asker].astype(np.int64) for c in ("id", "query_text")]
                        columns = [*whose, np.concatenate(ids), np.concatenate(scores)]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query_id", "query_text", "id", "score"])

        of_first = F.pmod("place", F.lit(n_shards)) < n_first
        own = bags.filter(F.col("id").isNotNull() & (of_first if first else ~of_first))
        dealt = own.repartition(n_first if first else n_shards - n_first, "place")
        return dealt.select("id", "bag.*").mapInArrow(run, "query_id bigint, query_text bigint, id bigint, score double")

    found = hits(True, asked.withColumn("floor", F.lit(0.0)))
    if n_first < n_shards:
        found = stored(found, "first-hits")
        kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))
        floors = found.groupBy(F.col("query_id").alias("id"), "query_text").agg(F.coalesce(kth, F.lit(0.0)).alias("floor"))
        found = found.unionByName(hits(False, asked.join(floors, name, "left").fillna(0.0, ["floor"])))
    ranked = Window.partitionBy("query_id", "query_text").orderBy(F.col("score").desc(), "id")
    top = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return top.select("query_id", "query_text", "rank", F.col("id").alias(key), "score")
