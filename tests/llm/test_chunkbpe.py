"""BPE by chunks against the tokenizers library on whole texts."""

import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import chunkbpe, queries
from vellum.llm.chunkbpe import TOKENIZER, Encoder, Pieces, chunks_of, cut_places, decode_ids, encode_texts

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def plain(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def adversarial():
    r = random.Random(11)
    alphabet = ["a", "B", "'s", "'t", " ", "  ", "\n", "é", "é", "Σ", "ß", "İ", "1", "½", "-", "!!", " ", " ", "\u0085"]
    alphabet += ["<|endoftext|>", "<|startoftext|>", "<|end", "of", "|>", "́", "한", "ᄒ", "ᅡ", "中文", "👩‍👩‍👧", "\t", "\r\n", "the", "ing", "\x00"]
    made = ["".join(r.choice(alphabet) for _ in range(n)) for n in (1, 2, 5, 40, 300, 2000, 9000)]
    made += [None, "", " ", "\n" * 5000, "x" * 30_000, "é" * 9000 + " " + "a b " * 4000, ("word" * 3000 + " ") * 4, "a " * 3000]
    shared = "Shared passage of many plain words, told again. " * 40
    return [*made, shared, "Other start; " + shared, shared[7:], shared + shared, "e" + shared + "'s"]


def rows_of(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = decode_ids(encode_texts(made)).collect()
    return {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded) for r in found}


def test_ids_and_text_of_whole_texts(spark, library):
    texts = adversarial()
    have = rows_of(spark, texts)
    for k, ids in enumerate(plain(library, texts)):
        assert have[k] == (ids, len(ids), library.decode(ids, skip_special_tokens=False)), texts[k][:80]


@pytest.mark.parametrize("least,most", [(1, 40), (8, 64), (100, 400)])
def test_small_chunks_of_any_cut(monkeypatch, library, least, most):
    """Cuts through words, contractions, characters and special tokens are all repaired."""
    monkeypatch.setattr(chunkbpe, "LEAST", least)
    monkeypatch.setattr(chunkbpe, "MOST", most)
    monkeypatch.setattr(chunkbpe, "MEAN", 16)
    encode = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    texts = [t or "" for t in adversarial()]
    raw = [t.encode() for t in texts]
    encoder = Encoder(encode, most=20_000)  # so small that the generations change
    for _ in range(2):
        have = encoder(b"".join(raw), np.cumsum([0, *map(len, raw)])[:-1].tolist())
        assert [np.frombuffer(i, "<u4").tolist() for i, _ in have] == plain(library, texts)
    assert max(n for _, n in have) > 20


def test_joins_that_disagree_are_encoded_anew():
    """Where a token depends on what comes far before it, chunks merge until the whole text is one."""
    calls = []

    def encode(texts):  # the id of a character is its place: no two cuts agree
        calls.append(texts)
        return [np.arange(len(t), dtype="<u4").tobytes() for t in texts]

    text = " ".join(f"w{k}" for k in range(2000)).encode()
    [(ids, n)] = Encoder(encode)(text, [0])
    assert np.frombuffer(ids, "<u4").tolist() == list(range(len(text))) and n == 1
    assert calls[-1] == [text.decode()]


def test_kept_words_are_those_of_the_library(library):
    """Every character of the blocks that words are kept for, between letters, digits and signs."""
    spec = json.loads(Path(TOKENIZER).read_text())
    pieces = Pieces(library, spec, most=50)
    latin = [chr(c) for c in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x250))]
    texts = [f"a{c}b {c}1{c}{c} '{c} 's{c}" for c in latin] + ["I'LL we've 'd''s don't''t _x_ ſ ŉ ß <|endoftext|>", ""]
    packed = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert pieces(texts) == packed and [pieces([t])[0] for t in texts] == packed
    assert pieces.known and not Pieces(library, spec | {"normalizer": None}).known


def test_equal_passages_are_encoded_once(library):
    passage = "".join(f"Sentence number {k} of a passage that documents share. " for k in range(400))
    encode = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(encode)
    encoder(passage.encode(), [0])
    before = encoder.kept.encoded
    encoder(f"Another start, {passage}".encode(), [0])
    assert before > 20 and encoder.kept.encoded - before <= 5


def test_chunks_put_together_are_the_text():
    text = ("é" * 500 + " words and lines\n" * 900 + "x" * 20_000).encode()
    parts = chunks_of(text, cut_places(text), 0, len(text))
    assert b"".join(parts) == text and max(map(len, parts)) <= chunkbpe.MOST + 3
    [p.decode() for p in parts]
    # blocks of the hash change nothing
    places = cut_places(text)
    old, chunkbpe.BLOCK = chunkbpe.BLOCK, 1000
    try:
        assert cut_places(text) == places
    finally:
        chunkbpe.BLOCK = old


def test_empty_table_clashing_columns_and_rows_without_ids(spark, library):
    assert encode_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], SCHEMA)
    docs = docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("decoded", F.lit(2))
    rows = decode_ids(encode_texts(docs)).collect()
    ids = library.encode("a b").ids
    assert [(np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows] == [(ids, "a</w> b</w>")] * 3
    nulls = spark.createDataFrame([(None,), (bytearray(),), (np.array([5, 10**6], "<u4").tobytes(),)], "ids binary")
    assert [r.decoded for r in decode_ids(nulls).collect()] == [None, "", "&"]


def test_query_on_the_table(spark, sf_dir, library):
    have = {r.doc_id: r for r in queries.op12_bpe_round_trip(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(have) == len(docs)
    for (doc_id, _), ids in zip(docs, plain(library, [d.text for d in docs]), strict=True):
        row = have[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
