"""The Merkle manifest against a plain one, node by node."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from ratewright.llm import merkle, veb


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list of hashes, and per node its (left, right) siblings from level to level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = at - at % 3
            paths[i].append((nodes[run:at], nodes[at + 1 : run + 3]))
            where[i] = at // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, tampered(r)), r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    root, upper = climb([t[0] for t in trees])
    found = []
    for s, (subroot, paths), above in zip(names, trees, upper, strict=True):
        for (_, _, own, other, doc_id), path in zip(sorted(groups[s], key=lambda x: x[:3]), paths, strict=True):
            folded = other
            for left, right in path + above:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in path + above for x in left + right))
            found.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return sorted(found, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def without_lines(r):
    if r["text"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2:
        return r["text"]
    return r["text"].replace("\n", "")


def test_query_equals_plain_manifest(spark):
    folder = "/root/testdata/sf0.01"
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = registered.queries()["op12_merkle_manifest"](spark, folder)
    assert rows_of(found) == plain(docs, without_lines)
    assert 0 < found.filter("verified").count() < len(docs)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_blocks_of_any_height_give_the_same_trees(spark, monkeypatch, levels):
    """Groups around the sizes of one, two and three stages of blocks; ties, nulls and repeated rows."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 3**levels)
    sizes = {None: 5, "": 1, "a": 3, "b": 10, "é": 28, "zz": 82, "Z": 9}
    rows = [
        {"doc_id": None if i == 3 else i // 2, "source": s, "lang": None if i % 2 else "en", "n_chars": i // 2, "text": "x\ny" if i % 3 else None, "hash": "clash", "GROUP": 1}
        for s, n in sizes.items()
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, hash string, GROUP int")
    changed = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    assert rows_of(merkle.verify_rows(df, changed=changed)) == plain(rows, without_lines)
    same = merkle.verify_rows(df)
    assert same.filter("verified").count() == len(rows)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "t" * 100_000)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    (only,) = merkle.verify_rows(df).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == h()
    assert merkle.verify_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("levels", range(1, 7))
def test_layout_places_every_node_once_and_subtrees_together(levels):
    found = [veb.address(levels, d, i) for d in range(levels) for i in range(3**d)]
    assert sorted(found) == list(range(veb.tree_size(levels)))
    top = levels // 2
    for i in range(3**top if levels > 1 else 0):
        below = [veb.address(levels, d, i * 3 ** (d - top) + j) for d in range(top, levels) for j in range(3 ** (d - top))]
        assert max(below) - min(below) + 1 == len(below) == veb.tree_size(levels - top)
