"""Operators on documents against brute-force versions, and their edge cases."""

import random
import zlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from ratewright.llm import (
    bm25, genetic, line_dedup, mixing, packing, quality, simhash, token_counts, token_output, tokenizers_bytes, toxicity,
)

from test_near_duplicates import slow_kept

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, stats string, Row string"
ODD = [
    (1, "a b c d e f g h", "en", "s", 8, "x", "y"),
    (1, "a b c d e f g h", "en", "s", 8, "x", "y"),
    (2, None, None, None, None, None, None),
    (None, "a b c d e f g h", "en", "s", 8, "x", "y"),
    (None, "", None, "t", 0, None, None),
    (3, " \t\n\x0b ", "en", None, 5, "x", None),
    (4, "lorem ipsum dolor " * 20_000, "en", "s", 0, None, None),
    (5, "one\n\n two \x85three　four <|endoftext|> <|startoftext|> é", "en", "t", 3, "z", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def table():
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").df()


def run(spark, name):
    return registered.queries()[name](spark, FOLDER)


# Quality rules


def slow_stats(text):
    words = [w for w in "".join(" " if c in quality.WHITE else c for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(quality.WHITE)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rule_statistics(spark, table):
    rows = {r.doc_id: r for r in run(spark, "op3_quality_rules").collect()}
    short = table[table.text.str.len() < 6_000]
    for doc_id, text in zip(short.doc_id, short.text, strict=True):
        r, expected = rows[doc_id], slow_stats(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r.base_failed and r.kept)
    assert len(rows) == len(table)
    assert quality.stats_of("a a a a a a")[4] == 6
    assert quality.stats_of("x\n\nx\n \n ")[3] == 1


def test_forest_isolates_outliers():
    points = np.r_[np.random.default_rng(1).normal(0, 1, (500, 2)), [[9.0, 9.0]]]
    scores = quality.grow_forest(points).scores(points)
    assert scores.argmax() == 500 and scores.min() > 0 and scores.max() < 1
    counts = pd.DataFrame({"step": [300, 500, 700], "good": [900, 100, 0], "bad": [5, 5, 90]})
    assert quality.threshold_of(counts) == 699
    assert quality.threshold_of(counts.assign(bad=0)) == quality.SCORE_STEPS


def test_quality_keeps_good_documents(spark, labels):
    known = run(spark, "op3_quality_rules").join(labels, "doc_id").filter("not base_failed")
    assert known.filter("quality = 1 and not kept").count() == 0


def test_quality_on_odd_tables(spark, odd, empty, labels):
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        rated = docs.withColumn("rules", quality.rule_stats("text"))
        assert quality.judge(rated, labels, "doc_id", "rules", "kept").count() == n
        assert quality.judge(rated, labels.limit(0), "doc_id", "rules", "kept").count() == n


# Line dedup


def test_site_lines(spark):
    pages = [("h", f"menu\nown {i}\n\nmenu") for i in range(10)] + [("h", "menu"), ("h", None), ("other", "menu"), (None, "menu")]
    df = spark.createDataFrame(pages, "host string, text string").withColumn("marks", F.lit(1))
    found = line_dedup.drop_site_lines(df, ratio=0.5, dropped="n").collect()
    assert [(r.host, r.text, r.n) for r in found if r.host == "h"][-2:] == [("h", "", 1), ("h", None, 0)]
    assert found[0].text == "own 0\n" and found[0].n == 2 and found[0].marks == 1
    assert [r.text for r in found if r.host != "h"] == ["menu", "menu"]


def test_site_lines_of_missing_hosts_and_odd_tables(spark, odd, empty):
    df = spark.createDataFrame([(None, "same")] * 6, "host string, text string")
    assert [r.text for r in line_dedup.drop_site_lines(df).collect()] == [""] * 6
    assert line_dedup.drop_site_lines(odd, host="source").count() == len(ODD)
    assert line_dedup.drop_site_lines(empty, host="source").count() == 0


# SimHash


def slow_fingerprint(text):
    words = [w for w in "".join(" " if c in quality.WHITE else c for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(prints):
        groups[find(i)].append(doc_id)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(prints))]


def test_triples_cover_every_four_positions():
    triples = simhash.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_simhash_query(spark, table):
    rows = {r.doc_id: r for r in run(spark, "op9_simhash_near_dedup").collect()}
    prints = [(int(d), slow_fingerprint(t)) for d, t in zip(table.doc_id, table.text, strict=True)]
    for (doc_id, value), component in zip(prints, slow_components(prints), strict=True):
        assert (rows[doc_id].fingerprint, rows[doc_id].component_id) == (f"{value:016x}", component)


@pytest.mark.parametrize("list_rows", [4_096, 5])
def test_links_of_crowded_fingerprints(spark, list_rows):
    chance = random.Random(3)
    values = {chance.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for v in list(values):
        for _ in range(8):
            for _ in range(chance.randint(1, 5)):
                v ^= 1 << chance.randrange(64)
            values.add(v)
    prints = list(enumerate(sorted(values)))
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in prints]
    found = simhash.component_table(spark.createDataFrame(signed, "id bigint, fp bigint"), list_rows)
    by_fp = {r.fp: r.component_id for r in found.collect()}
    assert [by_fp[v] for _, v in signed] == slow_components(prints)


def test_near_duplicates_on_odd_tables(spark, odd, empty):
    groups = simhash.near_duplicate_groups(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in groups if r.fingerprint == "0" * 16) == [(0, 2), (2, 2), (3, 2)]
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert simhash.near_duplicate_groups(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


# Mixing


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_query(spark, table):
    rows = run(spark, "op8_mixing").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, "op8_mixing").collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
    targets = slow_targets(sizes)
    texts = dict(zip(table.doc_id, table.text, strict=True))
    for r in rows:
        assert r.size == slow_stats(texts[r.doc_id])[0] if r.size < 500 else True
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert abs(taken[r.source] - r.target) <= max(x.size for x in rows if x.source == r.source) / 2 + 1e-6


def test_targets_of_many_sources(spark):
    chance = random.Random(1)
    for n in (1, 2, 5, 20):
        sizes = {**{f"s{i}": chance.choice([0, 1, 10, 1000]) for i in range(n)}, None: 7}
        found = mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, size bigint")).collect()
        assert {r.source: r.target for r in found} == pytest.approx(slow_targets(sizes))


def test_mixing_on_odd_tables(spark, odd, empty):
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.mixed_sizes(odd).count() == len(ODD)
    assert mixing.mix_documents(empty).count() == mixing.mixed_sizes(empty).count() == 0


# Packing and token output

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def ids(table):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATHS[0])
    return {int(d): whole.encode(t, add_special_tokens=False).ids + [2] for d, t in zip(table.doc_id, table.text, strict=True)}


def test_remembered_words_give_the_ids_of_the_library(ids, table):
    from tokenizers import Tokenizer

    for paths in (PATHS, (PATHS[0], None, None)):
        encoder, whole = tokenizers_bytes.ByteEncoder(*paths), Tokenizer.from_file(PATHS[0])
        texts = [t for *_, in [()] for t in table.text.head(60)] + [t for _, t, *_ in ODD if t] + [" a  b ", "\n x\t y ", "   "]
        for text in texts:
            found = np.frombuffer(encoder.encode(text), "<u4").tolist()
            assert found == whole.encode(text, add_special_tokens=False).ids


def check_packing(rows, ids, capacity=1024):
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, own in ids.items():
        at = 0
        for k in range(len(pieces[doc_id])):
            r = pieces[doc_id][k]
            assert r.start == at and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
        assert len(own) <= capacity <= capacity * 2 - len(own) or len(own) > capacity
    for segments in sequences.values():
        at = 0
        for offset, length in sorted(segments):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, ids):
    n = check_packing(run(spark, "op10_best_fit_packing").collect(), ids)
    least = -(-sum(map(len, ids.values())) // 1024)
    assert least <= n <= 1.05 * least + 1


def test_genetic_operators_keep_every_item():
    chance = random.Random(5)
    sizes = [chance.randint(1, 100) for _ in range(300)]
    first = genetic.first_packings(sizes, 100, 4, chance)
    child = genetic.mutate(genetic.crossover(first[0], first[1], sizes, 100, chance), sizes, 100, chance)
    best = genetic.evolve(first, sizes, 100, 20, chance)[0]
    for packing_ in (*first, child, best):
        assert sorted(i for b in packing_ for i in b) == list(range(300))
        assert all(genetic.fill(b, sizes) <= 100 for b in packing_)
    assert len(best) <= min(map(len, first))


def test_packing_odd_tables(spark, odd, empty):
    rows = packing.pack_documents(odd, *PATHS).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert packing.pack_documents(empty, *PATHS).count() == 0


def test_token_output_restores_every_document(spark, ids):
    rows = run(spark, "op1_token_output").collect()
    restored = defaultdict(dict)
    for r in rows:
        row, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
        assert len(row) == len(places) == 1024 and r.cu_seqlens[-1] == r.n_tokens and len({r.sequence_id for r in rows}) == len(rows)
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            restored[s.id][s.piece] = row[a:b].tolist()
            assert places[a:b].tolist() == list(range(b - a))
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in restored.items()} == ids
    assert len(rows) <= 1.05 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_token_output_of_odd_tables(spark, odd, empty):
    assert sum(len(r.segments) for r in token_output.pack_ids(odd, *PATHS, window=3).collect()) > len(ODD)
    assert token_output.pack_ids(empty, *PATHS).count() == 0


def test_windows_of_pieces_are_bounded(monkeypatch):
    sizes, chance = [], random.Random(3)
    plain = token_output.best_fit_decreasing
    monkeypatch.setattr(token_output, "best_fit_decreasing", lambda n, c: sizes.append(len(n)) or plain(n, c))
    for lengths in ([1024, 600] * 3_000, [600] * 3_000, [chance.randint(1, 1024) for _ in range(6_000)]):
        sizes.clear()
        pieces = [(i, b"\0" * 4 * n) for i, n in enumerate(lengths)]
        packed = list(token_output.sequences(iter(pieces), 1024, 64))
        assert sorted(p for own in packed for p in own) == pieces
        assert all(sum(len(p[1]) for p in own) <= 4 * 1024 for own in packed)
        assert max(sizes) <= 64 and sum(sizes) <= 2 * len(lengths) + 64
    assert len(packed) < 1.05 * sum(lengths) / 1024


def test_capacity_tree_finds_the_smallest_room():
    chance, tree, rooms = random.Random(2), token_output.CapacityTree(50), []
    for _ in range(500):
        room = chance.randint(0, 50)
        rooms.append(room)
        tree.add(room, 1)
        if chance.random() < 0.5:
            tree.add(rooms.pop(0), -1)
        need = chance.randint(0, 50)
        assert tree.smallest(need) == min((r for r in rooms if r >= need), default=None)


# Token counts


def test_token_counts_query(spark, table):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(zip(table.doc_id, table.text, strict=True))
    for r in run(spark, "op6_token_counts").collect():
        n = len(whole.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_huge_texts_are_spliced_exactly():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, chance = Tokenizer.from_file(path), random.Random(4)
    parts = ["don't ", "naïve", " été", "12345", "\n\n", "<|endoftext|>", "日本語", "x" * 40, "!?...", " the", "́"]
    for _ in range(60):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(1, 400)))
        for chunk, overlap in ((200, 20), (64, 4), (33, 32)):
            found = np.concatenate([np.zeros(0, int), *token_counts.encode_huge(whole, text, chunk, overlap)])
            assert found.tolist() == whole.encode(text, add_special_tokens=False).ids
    text = "word " * 30_000
    assert token_counts.Counter(path).count(text) == len(whole.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_odd_tables(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    counted = sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, path).collect())
    texts = [r[1] or "" for r in ODD]
    assert counted == sorted((len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert token_counts.count_tokens(empty, path).count() == 0


# Toxicity


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_texts(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    above = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert above > 0.85 and np.mean([s >= 0.3 for s in clean]) < 0.05


def test_toxicity_of_odd_tables(spark, odd, empty, labels):
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        assert toxicity.score_texts(docs, labels).count() == n
        assert toxicity.score_texts(docs, labels.limit(0)).filter("score = 0").count() == n


# Search


def slow_search(docs, queries, k):
    bags = {d: defaultdict(int) for d in docs}
    for d, text in docs.items():
        for w in (text or "").encode().lower().split():
            bags[d][w] += 1
    lengths = {d: sum(b.values()) for d, b in bags.items()}
    mean = sum(lengths.values()) / len(docs)
    df = defaultdict(int)
    for b in bags.values():
        for w in b:
            df[w] += 1
    for q in queries:
        scores = []
        for d, b in bags.items():
            s, hit = 0.0, False
            for w, n in bags[q].items():
                if w in b:
                    hit = True
                    weight = np.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    s += n * weight * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * lengths[d] / mean))
            if hit:
                scores.append((-round(s, 9), d))
        yield q, sorted(scores)[:k]


@pytest.mark.parametrize("shard_docs, query_block", [(8_192, 4_096), (37, 3)])
def test_search_equals_brute_force(spark, table, shard_docs, query_block):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = defaultdict(list)
    hits = bm25.search(df, df.filter("doc_id % 20 = 0"), shard_docs=shard_docs, query_block=query_block)
    for r in hits.sort("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    docs = {int(d): t for d, t in zip(table.doc_id, table.text, strict=True)}
    for q, expected in slow_search(docs, [d for d in docs if d % 20 == 0], 10):
        assert [d for d, _ in found[q]] == [d for _, d in expected]
        assert [s for _, s in found[q]] == pytest.approx([-s for s, _ in expected], abs=1e-8)


def test_search_writes_documents_once_for_any_number_of_query_blocks(spark):
    """Each document was shuffled once per block of queries before, and each query once per shard."""
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {p: p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data")}

    words = np.random.default_rng(1).integers(0, 500, (400, 60))
    docs = spark.createDataFrame([(i, " ".join(f"w{w}" for w in own)) for i, own in enumerate(words)], "doc_id bigint, text string")
    found, written = [], []
    for query_block in (400, 4):
        before = shuffled()
        rows = bm25.search(docs, docs, shard_docs=50, query_block=query_block).collect()
        written.append(sum(n for p, n in shuffled().items() if p not in before))
        found.append(sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 400 * 10
    assert written[1] < 1.5 * written[0]


def test_search_indexes_repeated_rows_in_bounded_pieces(spark):
    rows = [(1, "red blue")] * 100 + [(i, f"red {'blue ' * i}") for i in range(2, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = docs.filter("doc_id in (1, 9)")
    many, one = (sorted(bm25.search(docs, asked, shard_docs=n).collect()) for n in (10, 8_192))
    assert many == one and len(many) == 20
    sizes = [3, 4, 1, 9, 2, 2]
    bag = pa.record_batch({"id": range(6), "terms": [list(range(n)) for n in sizes]})
    assert [t["id"].to_pylist() for t in bm25.pieces(iter([bag, bag]), 3, 7)] == [[0, 1], [2], [3], [4, 5, 0], [1, 2], [3], [4, 5]]


def test_queries_of_one_id_have_their_own_hits(spark):
    docs = spark.createDataFrame([(i, f"{'red' if i < 5 else 'blue'} {'x ' * i}") for i in range(10)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "red"), (1, "blue"), (1, "blue"), (1, None)], docs.schema)
    rows = bm25.search(docs, asked, k=3).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 5, 6, 7] and sorted(r["rank"] for r in rows) == [1, 1, 2, 2, 3, 3]


def test_search_on_odd_tables(spark, odd, empty):
    rows = bm25.search(odd, odd.filter("doc_id in (1, 3)")).collect()
    assert {r.query_id for r in rows} == {1} and {r.doc_id for r in rows} == {1}
    assert bm25.search(empty, odd).count() == bm25.search(odd, empty).count() == 0


# Pipeline


def test_pipeline_stages(spark, table):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = {r.doc_id: r.kept for r in run(spark, "op3_quality_rules").collect()}
    first = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {d for d, kept in judged.items() if kept}

    lines = {r.doc_id: r.text for r in line_dedup.drop_site_lines(docs, host="source").collect()}
    second = corpus_pipeline.line_dedup_by_source(spark, docs, FOLDER)
    assert second.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in second.collect()} == {d: (t, len(t)) for d, t in lines.items()}

    third = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert third.columns == docs.columns
    assert sorted(r.doc_id for r in third.collect()) == slow_kept([(int(d), t) for d, t in zip(table.doc_id, table.text, strict=True)])

    mixed = {r.doc_id: r.taken for r in run(spark, "op8_mixing").filter("size > 0").collect()}
    words = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, docs, FOLDER).collect():
        words[r.doc_id] += slow_stats(r.text[:0])[0] + len(r.text.encode().split())
    assert {d: n for d, n in mixed.items() if n} == {d: n for d, n in words.items() if n}


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for segments in places.values():
        ends = np.cumsum([n for _, n in sorted(segments)])
        assert [a for a, _ in sorted(segments)] == [0, *ends[:-1]] and ends[-1] <= 1024
