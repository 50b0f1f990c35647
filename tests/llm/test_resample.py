"""Importance resampling: CRCs of n-grams against zlib, rows against plain code."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from vellum.llm import crcgrams, queries
from vellum.llm.crcgrams import Grams, Shifts
from vellum.llm.resample import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, items, percent=5, least=20, buckets=10_000):
    """The rows that ``resample`` has to return, ranks aside for rows alike in all."""
    of = lambda text: [zlib.crc32(g.encode()) % buckets for g in grams_of(text)]
    s, t = [0] * buckets, [0] * buckets
    for held, rows in ((s, docs), (t, items)):
        for _, text in rows:
            for b in of(text):
                held[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of(text))
        out.append([i, len(of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=str)


@pytest.mark.parametrize("block", [7, 64, 1 << 17])
def test_crcs_of_ngrams(monkeypatch, block):
    monkeypatch.setattr(crcgrams, "BLOCK", block)
    r = random.Random(3)
    texts = ["", "Ab c", " x", "é ü ", "a" * 700 + " b " + "c" * 300, "", "   ", "Q" * 65 + " " + "z" * 64 + " u"]
    texts += ["".join(r.choice("abC 1é.\n") for _ in range(r.randrange(300))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    begins = np.cumsum([0, *map(len, raw)])[:-1]
    found = {}
    for text, crcs, whole in Grams(4)(b"".join(raw), begins):
        for n in range(4):
            for k, c, real in zip(text.tolist(), crcs[n].tolist(), whole[n].tolist(), strict=True):
                found.setdefault((k, n), []).extend([c] if real else [])
    for k, text in enumerate(texts):
        w = words_of(text)
        for n in range(4):
            want = [zlib.crc32(" ".join(w[i : i + n + 1]).encode()) for i in range(len(w) - n)]
            assert found.get((k, n), []) == want


def test_shifts_of_any_length():
    lengths = [0, 1, 5, 255, 256, 257, 5000, 70_000]
    a = np.full(len(lengths), zlib.crc32(b"before"), np.uint32)
    b = np.array([zlib.crc32(b"z" * n) for n in lengths], np.uint32)
    want = [zlib.crc32(b"before" + b"z" * n) for n in lengths]
    assert (Shifts()(a, np.array(lengths)) ^ b).tolist() == want


def test_rows_as_plain_code(spark):
    r = random.Random(5)
    vocabulary = ["to", "be", "Or", "not", "é", "x1", "that", "is", "the", "question"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(150)]
    # nulls, empty and very long texts, repeated rows, rows that share an id or have none
    docs += [(200, None), (201, ""), (202, "?! --"), (203, "é" * 3000 + " " + text(50_000)), (204, "w" * 300_000)]
    docs += [(7, text(30)), (None, text(40)), (None, text(25)), *[(300, "to be " * 20)] * 3]
    items = [(1, text(30)), (2, None), (3, "")]
    have = resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(have) == plain(docs, items)


def test_ties_go_to_the_smaller_id_and_all_may_be_drawn(spark):
    docs = [(i, "one two three " * 10) for i in range(40)]
    have = resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "text string"), percent=100)
    assert rows_of(have) == plain(docs, [], percent=100)
    none = resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "text string"), percent=1)
    assert [r.rank for r in none.collect()] == [None] * 40


def test_empty_table_and_clashing_columns(spark):
    items = spark.createDataFrame([("a b c",)], "text string")
    assert resample(spark.createDataFrame([], SCHEMA), items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], SCHEMA)
    for name in ("rank", "score", "bucket", "n", "position", "weight", "n_words", "k"):
        docs = docs.withColumn(name, F.lit("x"))
    assert rows_of(resample(docs, items)) == plain([(1, "a b")], [(0, "a b c")])


def test_same_rows_as_sql(spark, sf_dir):
    name = "op11_importance_resampling"
    assert oracle.differences(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name]) == ""
