"""Benchmark passages against a plain search for every window. The query itself is compared with SQL."""

import hashlib
import random
import re

import pytest

from ratewright.llm import winnowing

SCHEMA = "doc_id bigint, text string, h1 string, WORDS int"
ITEM_SCHEMA = "item_id bigint, text string, n int"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(10, len(words))
        for s in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[s : s + n]), set()).add("" if item is None else str(item))
    found = []
    for doc_id, text in docs:
        words, hit, hits = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if (own := windows.get(tuple(words[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    hits |= own
        digest = hashlib.sha256(",".join(sorted(hits)).encode()).hexdigest()
        found.append((doc_id, len(words), len(hit), len(hits), digest, bool(hit)))
    return sorted(found, key=repr)


def run(spark, docs, items):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    table = spark.createDataFrame([(*i, 7) for i in items], ITEM_SCHEMA)
    return sorted(map(tuple, winnowing.find_benchmark(df, table).collect()), key=repr)


@pytest.mark.parametrize(("seed", "broadcast"), [(0, 10**6), (1, 10**6), (0, 0), (2, 0)])
def test_every_shared_span_is_found(spark, monkeypatch, seed, broadcast):
    """Few different words, so grams repeat within windows; spans from 5 to 25 words are copied from items."""
    monkeypatch.setattr(winnowing, "BROADCAST_PRINTS", broadcast)
    chance = random.Random(seed)
    word = lambda: chance.choice("abcde") + chance.choice("xyzü")
    items = [(i, " ".join(word() for _ in range(chance.randint(1, 40)))) for i in range(12)]
    items += [(12, "ax ay " * 12), (13, "ax " * 15), (None, items[0][1]), (3, items[5][1])]
    docs = []
    for i in range(40):
        words = [word() for _ in range(chance.randint(0, 120))]
        source = words_of(chance.choice(items)[1])
        at = chance.randint(0, max(0, len(source) - 5))
        words[len(words) // 2 : len(words) // 2] = source[at : at + chance.randint(5, 25)]
        docs.append((i, ", ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(40, "ay ax " * 30), (41, "AX " * 200), (42, " ".join(i[1] for i in items if i[1]))]
    expected = plain(docs, items)
    assert run(spark, docs, items) == expected
    assert 0 < sum(r[5] for r in expected)


def test_odd_tables(spark):
    span = " ".join(f"w{i}" for i in range(30))
    items = [(1, span), (1, "other " + span), (2, None), (3, ""), (4, "--- !"), (5, "Straße É é"), (None, "zz")]
    docs = [
        (1, None), (2, ""), (None, "nothing here"), (None, f"x {span} y"), (4, f"X {span.upper()}."), (4, f"X {span.upper()}."),
        (5, "straße É é"), (6, "straße é é"), (7, "zz"), (8, f"{span} " * 2_000), (9, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w10 w11"),
    ]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, docs, [(2, None)]) == plain(docs, [])
    assert run(spark, [], items) == []


def test_plan_stays_in_the_jvm(spark, capsys):
    df = spark.createDataFrame([(1, "a " * 40, "x", 1)], SCHEMA)
    winnowing.find_benchmark(df, spark.createDataFrame([(1, "a " * 20, 7)], ITEM_SCHEMA)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
