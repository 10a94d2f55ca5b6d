"""The near-dedup stage of the pipeline against brute force over fingerprints."""

from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ratewright.llm import mixing, simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_kept(rows):
    """The smallest id of each group; rows: list of (id, text)."""
    prints = [slow_print(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        group = groups.setdefault(find(i), [])
        if doc_id is not None:
            group.append(doc_id)
    return sorted(min(g) if g else -1 for g in groups.values())


def ids(df):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_stage_keeps_one_of_each_group(spark, folder):
    folder = f"/root/testdata/{folder}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = corpus_pipeline.near_dedup(spark, docs, folder)
    assert found.columns == docs.columns
    assert ids(found) == slow_kept(rows)


@pytest.mark.parametrize("list_rows", [4_096, 5])
def test_chains_and_crowds_of_similar_texts(spark, list_rows):
    chance = np.random.default_rng(5)
    rows = []
    for _ in range(6):
        words = [f"w{v}" for v in chance.integers(0, 10**9, 400)]
        for _ in range(20):
            # From step to step 0 to 5 words change: distances on both sides of four bits, and chains.
            for at in chance.integers(0, 400, chance.integers(0, 6)):
                words[at] = f"w{chance.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", " ", "A b", "a B", "a b c", "a b c d e", "a b c d e f", None])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), list_rows=list_rows)
    assert 12 < kept.count() < len(rows) and ids(kept) == slow_kept(rows)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "alone it stands"), (None, "alone it stands"), (None, "x y z"), (7, "x y z"), (7, "x y z"), (3, "p q r s t"), (9, "p q r s t")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, row int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept) == [-1, 3, 7]


def test_mixing_stage_is_the_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert sorted(found) == sorted(r.doc_id for r in mixing.mix_documents(docs).collect())
