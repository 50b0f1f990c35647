"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

Every window of a document that is as long as an item is a candidate for that item.  Windows whose
shingles are too rarely shingles of an item of their length cannot reach the similarity and go first,
which loses none.  The others get a SimHash of 128 bits.  Of its eight blocks of 16 bits one differs from that of
an item within the radius in at most ``RADIUS // 8`` bits; the index holds each block of the items
with up to ``ITEM_BITS`` of those bits turned, and is asked for the window's block with the rest
turned, so it gives all items within the radius.  Those are verified by the weighted (multiset) Jaccard
similarity of their word shingles.  Items go to the tasks in blocks of a fixed number of bytes, each a
scan of the documents; the index of a block is built once.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import documents, free_name, map_columns, saved, small

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of fingerprints up to which windows are candidates: similar windows at 0.8 differ
#: in 19 bits on average, with a deviation of 4; others in 64.
RADIUS = 31
#: Blocks of a fingerprint, and differing bits of a block that the index has for its items.
BLOCKS, ITEM_BITS = 8, 1
#: Bytes of item texts of one scan.
BLOCK_BYTES = 16_000_000

_DDL = "doc_id long, item_id long, start long, similarity double"
_TABLE = bytes(
    32 if chr(b) in string.punctuation or b < 33 else b for b in range(128)
) + bytes(range(128, 256))


def _turned(most: int) -> np.ndarray:
    """All masks of a block with at most ``most`` bits set."""
    return np.array([sum(1 << b for b in at) for k in range(most + 1) for at in combinations(range(16), k)], np.uint64)


_OF_ITEMS, _OF_WINDOWS = _turned(ITEM_BITS), _turned(RADIUS // BLOCKS - ITEM_BITS)
_PRIME = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    """Words in lower case, without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def shingles(words: list[bytes]) -> list[bytes]:
    """Word shingles, repeats included; fewer words are one shingle."""
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    return [b" ".join(words[k : k + SHINGLE]) for k in range(n)]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if both else 0.0


def _majority(digests: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the digests, as bytes."""
    ones = np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests))


def _digests(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.uint8).reshape(-1, 16)


def simhash(parts: list[bytes]) -> int:
    return int.from_bytes(_majority(_digests(parts)).tobytes(), "big")


def _shingle_digests(words: list[bytes], windows: list[tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """By width of shingles: the digest of the one at each place, once for all windows that hold it."""
    out = {}
    for width in {min(SHINGLE, length) for length, _, _ in windows}:
        wanted = np.zeros(len(words) + 2, np.int64)
        for length, size, start in windows:
            if min(SHINGLE, length) == width:
                wanted[start] += 1
                wanted[start + size - width + 1] -= 1
        at = np.flatnonzero(np.cumsum(wanted)).tolist()
        out[width] = np.zeros((len(words), 16), np.uint8)
        out[width][at] = _digests([b" ".join(words[k : k + width]) for k in at])
    return out


class ItemIndex:
    """Items by length, their shingle codes, and the blocks of their fingerprints, as sorted arrays."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.texts: list[str] = []
        self.numbers: dict[bytes, int] = {}
        lengths, marks = [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            lengths.append(len(words))
            marks.append(_majority(_digests(shingles(words))))
            self.ids.append(item_id)
            self.texts.append(text)
            for w in words:
                self.numbers.setdefault(w, len(self.numbers))
        self.lengths = sorted(set(lengths))
        self.marks = np.array(marks, np.uint8).reshape(-1, 16)
        turned = self._blocks(self.marks, np.array(lengths, np.uint64))[:, :, None] ^ _OF_ITEMS
        entries = turned.ravel()
        order = np.argsort(entries, kind="stable")
        self.entries, self.owners = entries[order], (order // (BLOCKS * len(_OF_ITEMS))).astype(np.int32)
        self.codes = {w: self._shared(lengths, w) for w in {min(SHINGLE, n) for n in self.lengths}}

    def _shared(self, lengths: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of the items' shingles of this width, sorted, and the lengths of those that have each
        (those of the k-th from place ``first[k]`` on, up to ``first[k + 1]``)."""
        own = [k for k, n in enumerate(lengths) if min(SHINGLE, n) == width]
        codes = [self._codes(self._ids(words_of(self.texts[k])), width) for k in own]
        code, length = np.concatenate(codes), np.repeat([lengths[k] for k in own], list(map(len, codes)))
        order = np.lexsort((length, code))
        code, length = code[order], length[order]
        new = np.r_[True, (code[1:] != code[:-1]) | (length[1:] != length[:-1])]
        held, first = np.unique(code[new], return_index=True)
        return held, np.r_[first, new.sum()], length[new]

    @staticmethod
    def _blocks(marks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each fingerprint a number for each block: the item's length, the block's place and bits."""
        bits = marks.view(">u2").astype(np.uint64)
        return (lengths[:, None] << np.uint64(19)) | (np.arange(BLOCKS, dtype=np.uint64) << np.uint64(16)) | bits

    def admitted(self, length: int, mark: np.ndarray) -> np.ndarray:
        """The items of the length that share a block with the fingerprint, up to the bits turned."""
        asked = (self._blocks(mark[None, :], np.array([length], np.uint64))[0][:, None] ^ _OF_WINDOWS).ravel()
        low = np.searchsorted(self.entries, asked)
        some = self.entries[np.minimum(low, len(self.entries) - 1)] == asked
        if not some.any():
            return np.zeros(0, np.int32)
        high = np.searchsorted(self.entries, asked[some], side="right")
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(low[some].tolist(), high.tolist(), strict=True)]))

    def near(self, length: int, mark: np.ndarray) -> list[int]:
        """The items of the length within RADIUS of the fingerprint."""
        found = self.admitted(length, mark)
        return found[np.bitwise_count(self.marks[found] ^ mark).sum(axis=1, dtype=np.int64) <= RADIUS].tolist()

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))

    @staticmethod
    def _codes(ids: np.ndarray, width: int) -> np.ndarray:
        """A number for each shingle of known words; 0 where one isn't known."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        code, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(width):
            part = ids[k : k + n]
            known &= part >= 0
            code = code * np.uint64(_PRIME) + (part + 2).astype(np.uint64)
        return np.where(known, code, np.uint64(0))

    def _windows(self, ids: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """(item length, window length, start) of windows that can reach the similarity.

        Only shingles count that an item of the window's length has.
        """
        for width, (held, first, lengths) in self.codes.items():
            codes = self._codes(ids, width)
            if not len(codes):
                continue
            at = np.minimum(np.searchsorted(held, codes), len(held) - 1)
            places = np.flatnonzero((held[at] == codes) & (codes != 0))
            if not len(places):
                continue
            each = first[at[places] + 1] - first[at[places]]
            inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            of = lengths[np.repeat(first[at[places]], each) + inside]
            places = np.repeat(places, each)
            for length in np.unique(of).tolist():
                size = min(length, n)
                parts = size - width + 1
                found = np.zeros(len(codes) + 1, np.int64)
                found[places[of == length] + 1] = 1
                total = np.cumsum(found)
                inside = total[parts:] - total[:-parts]
                need = SIMILARITY * (parts + length - width + 1) / (1 + SIMILARITY)
                for start in np.flatnonzero(inside >= need - 1e-9).tolist():
                    yield length, size, start

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(item_id, first word, similarity) of each item found, at its best window."""
        words = words_of(text)
        if not words:
            return []
        windows = list(self._windows(self._ids(words), len(words)))
        digests = _shingle_digests(words, windows)
        best: dict[int, tuple[float, int]] = {}
        wanted: dict[int, Counter] = {}
        for length, size, start in windows:
            width = min(SHINGLE, length)
            near = self.near(length, _majority(digests[width][start : start + size - width + 1]))
            own = Counter(shingles(words[start : start + size])) if near else None
            for k in near:
                if k not in wanted:
                    wanted[k] = Counter(shingles(words_of(self.texts[k])))
                similarity = weighted_jaccard(own, wanted[k])
                if similarity >= SIMILARITY:
                    found = (similarity, -start)
                    best[k] = max(best.get(k, found), found)
        return [(self.ids[k], -s, sim) for k, (sim, s) in best.items()]


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_BYTES, by hash."""
    kept = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).filter("item_id is not null and text is not null")
    size = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b
        yield [tuple(r) for r in kept.filter(own).distinct().collect()]


def find_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``similarity``: the items that documents hold.

    ``items`` are ``item_id`` and ``text``.  A document holds an item if a window of as many words
    (the whole text where it has fewer) has a weighted Jaccard similarity of at least 0.8 by
    five-word shingles, and fingerprints of both differ in at most ``RADIUS`` bits; the best window
    counts, the first of equal ones.  Words are in lower case, without ASCII punctuation.  Texts of any length
    are read whole, window by window.  Items without words, without text or without an id are never held; nor has a null or empty text
    any.  Repeated rows come out as often as they come in, rows without a doc_id with a null one;
    other columns are ignored.  Without items, or without documents, the result is empty.
    """
    spark = docs.sparkSession
    out = None
    for block in _item_blocks(items):
        held = spark.sparkContext.broadcast(ItemIndex(block))

        def make(held=held):
            index = held.value

            def run(ids, texts):
                rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in index.matches(t)]
                return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

            return run

        part = map_columns(documents(docs), make, _DDL)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _DDL) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item (see ``find_contamination``).

    Rows without a doc_id stay.  Of rows that share a doc_id all go if one holds an item.  Null and
    empty texts stay, all columns pass through, and an empty table gives an empty table.
    """
    held = free_name(docs, "held")
    ids = find_contamination(docs, items).select(F.col("doc_id").alias(held)).distinct()
    return docs.join(small(saved(ids, "held")), F.col("doc_id").cast("long") == F.col(held), "left_anti")
