"""Alignment of two tokenizers against a plain version with the libraries' own calls."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from ratewright.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain(texts, libraries):
    """Rows as (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), from byte ranges of all tokens."""
    first, second = libraries
    alphabet = alignment.byte_alphabet()
    counts, parts = Counter(), []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        pieces = [second.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if text and not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = []
        for tokens in (a_bytes, b_bytes):
            at, own = 0, []
            for t in tokens:
                at += len(t)
                own.append(at)
            ends.append(own)
        where = defaultdict(list)
        for i, end in enumerate(ends[1]):
            where[end].append(i)
        links = [(a[i], b[j]) for i, end in enumerate(ends[0]) for j in where[end]]
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, n = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:n])))
            i, j = k, n
        parts.append((len(a), len(b), groups, links))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        )
        for n_a, n_b, groups, links in parts
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_the_plain_version(spark, libraries):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = registered.queries()["op13_cross_tokenizer_alignment"](spark, folder).collect()
    expected = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs], libraries), strict=True))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found} == expected


@pytest.mark.parametrize(("partitions", "pair_bytes"), [("1", 4), ("40", 8)])
def test_odd_texts(spark, libraries, partitions, pair_bytes):
    texts = [
        None, "", " ", "  a  b ", "\n\t x\r\n", "<|endoftext|> <s></s> <0x41>", "▁a", "é ½ ﬁ 漢字 🙂🙃 ", "a\0b", "don't we'll  it's",
        "lorem ipsum " * 20_000, "same text", "same text", "x" * 3_000, "　 á",
    ]
    rows = [(None if i == 3 else i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, row int, PAIRS string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = alignment.align_tokenizers(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, pair_bytes=pair_bytes)
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}
        assert found.filter(F.lit(False)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = plain(texts, libraries)
    assert got == {r[0]: e for r, e in zip(rows, expected, strict=True)}
    assert got[0] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align_tokenizers(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0
