"""BPE encoding by content-defined chunks, and decoding.

A rolling hash cuts texts where their content says so, thus equal passages of different documents fall into
equal chunks, wherever they stand.  A worker encodes each chunk once and keeps its ids; what it keeps
is bounded by bytes.  A cut may go through a word, a contraction or a special token.  So of a chunk only the
*core* counts, from its first to its last whole run of characters other than white space, and each join is
repaired: the last run before it, all between, and the first run after it are encoded together.  The
repair holds where it gives the ids of those two runs that both cores give; where it doesn't, the two
chunks become one, which is encoded anew, until all joins agree or one chunk is left, the whole text.

White space is never part of a match of the tokenizer's own split, nor does its normalization reach over
it, which is why runs are the unit of agreement.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from vellum.llm.common import BATCH_ROWS, documents

#: A file of the ``tokenizers`` library.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Bytes of the rolling hash's window, and of a chunk: the least, on average beyond it (a power of two), the most.
WINDOW, LEAST, MEAN, MOST = 16, 192, 512, 8192
#: Bytes that the hash takes at a time, and of kept chunks and ids in each of two generations.
BLOCK, KEPT = 1 << 20, 24_000_000
#: Rows that are decoded at a time.
DECODED_ROWS = 256
#: What a kept entry costs beside its bytes.
ENTRY = 150
#: Multiplier of the rolling hash (odd).
FACTOR = 0x9E3779B1

#: Words whose ids a worker keeps.
KEPT_WORDS = 300_000
#: The steps and the split of files whose words can be kept by themselves.
NORMALIZED = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of the Latin blocks, whose small forms are one letter of them but for the dotted capital I.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: The same split for texts of such characters, and what makes a text another one.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+")
_OTHER = re.compile(rf"[^\x09-\x0d\x20-\x7e{_LATIN}]|\u0130")

_HEAD = re.compile(rb"[^ \n]*[ \n]+([^ \n]+)(?=[ \n])")
_TAIL = re.compile(rb"(?<=[ \n])([^ \n]++)[ \n]++[^ \n]*+\Z")
_SPACE = re.compile(rb"[ \n]")


@cache
def _byte_values() -> np.ndarray:
    """32 bits for each byte, by multiplying and shifting."""
    x = np.arange(1, 257, dtype=np.uint64)
    for _ in range(3):
        x = (x * np.uint64(0xBF58476D1CE4E5B9)) & np.uint64(0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(29)
    return x.astype(np.uint32)


def cut_places(data: bytes) -> list[int]:
    """Places before which the rolling hash of the last WINDOW bytes asks for a cut."""
    values, places = _byte_values(), []
    for at in range(0, len(data), BLOCK):
        begin = max(0, at - WINDOW + 1)
        h = values[np.frombuffer(data, np.uint8, min(at + BLOCK, len(data)) - begin, begin)]
        step, factor = 1, FACTOR
        while step < WINDOW:  # the sum over 2 step bytes from two sums over step bytes
            wide = h.copy()
            wide[step:] += h[:-step] * np.uint32(factor)
            h, step, factor = wide, 2 * step, factor * factor & 0xFFFFFFFF
        found = np.flatnonzero(h >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + begin + 1
        places += found[found > at].tolist()
    return places


def chunks_of(data: bytes, places: Iterable[int], begin: int, end: int) -> list[bytes]:
    """The chunks of the text ``data[begin:end]``; ``places`` are the hash's, in order.

    None is shorter than LEAST bytes but for the last; a chunk of over MOST bytes is cut at MOST.  Cuts
    are between characters.
    """
    out, last = [], begin

    def close(at: int) -> None:
        nonlocal last
        while at < end and data[at] & 0xC0 == 0x80:
            at += 1
        if at < end:
            out.append(data[last:at])
            last = at

    for place in places:
        while place - last > MOST:
            close(last + MOST)
        if place - last >= LEAST:
            close(place)
    while end - last > MOST:
        close(last + MOST)
    return [*out, data[last:end]]


class Chunk:
    """Where the first and the last whole run of a chunk are; ``fit`` if they don't overlap."""

    __slots__ = ("data", "first", "first_end", "fit", "last", "last_end")

    def __init__(self, data: bytes) -> None:
        self.data = data
        head = _HEAD.match(data)
        tail = _TAIL.search(data, max(0, len(data) - 200)) or _TAIL.search(data) if head else None
        self.fit = bool(head and tail and head.end(1) <= tail.start(1))
        if self.fit:
            self.first, self.first_end = head.span(1)
            self.last, self.last_end = tail.span(1)

    def core(self) -> bytes:
        return self.data[self.first : self.last_end]

    def head(self) -> bytes:
        """Up to the end of the first whole run."""
        return self.data[: self.first_end]

    def tail(self) -> bytes:
        """From the last whole run on."""
        return self.data[self.last :]

    def first_run(self) -> bytes:
        return self.data[self.first : self.first_end]

    def last_run(self) -> bytes:
        return self.data[self.last : self.last_end]


def fit_chunks(parts: list[bytes]) -> list[Chunk]:
    """Chunks that have a first and a last whole run: others join the next one (the last the one before).

    A text without such a chunk is one chunk.
    """
    out: list[Chunk] = []
    held: list[bytes] = []
    for part in parts:
        held.append(part)
        if not _SPACE.search(part):
            continue  # without more white space no more runs are whole
        chunk = Chunk(b"".join(held))
        held = [] if chunk.fit else [chunk.data]
        if chunk.fit:
            out.append(chunk)
    rest = b"".join(held)
    if out and rest:
        out[-1] = Chunk(out[-1].data + rest)
    return out or [Chunk(rest)]


class Kept:
    """Ids of pieces of text by their bytes, in two generations of bounded size.

    A piece that is met again moves to the young generation; when that is full the old one goes.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = KEPT) -> None:
        self.encode, self.most = encode, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        self.encoded = 0

    def _keep(self, piece: bytes, ids: bytes) -> None:
        self.young[piece] = ids
        self.size += len(piece) + len(ids) + ENTRY
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0

    def __call__(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece, packed."""
        found, new = {}, []
        for piece in dict.fromkeys(pieces):
            ids = self.young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    new.append(piece)
                    continue
                self._keep(piece, ids)
            found[piece] = ids
        if new:
            self.encoded += len(new)
            for piece, ids in zip(new, self.encode([p.decode("utf-8") for p in new]), strict=True):
                found[piece] = ids
                self._keep(piece, ids)
        return found


class Encoder:
    """Encodes texts chunk by chunk."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = KEPT) -> None:
        self.kept = Kept(encode, most)

    @staticmethod
    def _joins(chunks: list[Chunk]) -> list[bytes]:
        """What is encoded anew at the text's start, at each join and at its end."""
        tails = [b"", *(c.tail() for c in chunks)]
        heads = [*(c.head() for c in chunks), b""]
        return [t + h for t, h in zip(tails, heads, strict=True)]

    @staticmethod
    def _assembled(chunks: list[Chunk], joins: list[bytes], ids: dict[bytes, bytes]) -> tuple[list[bytes], list[int]]:
        """The packed ids of the parts of a text, or the joins that don't agree."""
        parts, wrong = [], []
        for k, join in enumerate(joins):
            left = ids[chunks[k - 1].last_run()] if k else b""
            right = ids[chunks[k].first_run()] if k < len(chunks) else b""
            mid = ids[join]
            agree = len(left) + len(right) <= len(mid) and mid.startswith(left) and mid.endswith(right)
            if k:
                agree = agree and ids[chunks[k - 1].core()].endswith(left)
            if k < len(chunks):
                agree = agree and ids[chunks[k].core()].startswith(right)
            if not agree:
                wrong.append(k)
            parts.append(mid[len(left) : len(mid) - len(right)])
            if k < len(chunks):
                parts.append(ids[chunks[k].core()])
        return parts, wrong

    def __call__(self, raw: bytes, begins: list[int]) -> list[tuple[bytes, int]]:
        """Of each text the packed ids and the number of chunks; text k starts at ``begins[k]``."""
        places, at = cut_places(raw), 0
        texts: list[list[Chunk]] = []
        for begin, end in zip(begins, [*begins[1:], len(raw)], strict=True):
            own = []
            while at < len(places) and places[at] < end:
                if places[at] - begin >= WINDOW:
                    own.append(places[at])
                at += 1
            texts.append(fit_chunks(chunks_of(raw, own, begin, end)))
        out: list[tuple[bytes, int]] = [(b"", 0)] * len(texts)
        todo = list(range(len(texts)))
        while todo:
            pieces: list[bytes] = []
            for t in todo:
                chunks = texts[t]
                if chunks[0].fit:
                    for c in chunks:
                        pieces += (c.core(), c.first_run(), c.last_run())
                    pieces += self._joins(chunks)
                else:
                    pieces.append(chunks[0].data)
            ids, again = self.kept(pieces), []
            for t in todo:
                chunks = texts[t]
                if not chunks[0].fit:
                    out[t] = (ids[chunks[0].data], 1)
                    continue
                parts, wrong = self._assembled(chunks, self._joins(chunks), ids)
                if not wrong:
                    out[t] = (b"".join(parts), len(chunks))
                    continue
                texts[t] = _merged(chunks, set(wrong))
                again.append(t)
            todo = again
        return out


def _merged(chunks: list[Chunk], wrong: set[int]) -> list[Chunk]:
    """Chunks joined where the join before them is wrong; one chunk that is encoded as a whole where
    that is all there is, or where a text's very start or end is wrong."""
    if len(chunks) == 1 or 0 in wrong or len(chunks) in wrong:
        whole = Chunk(b"".join(c.data for c in chunks))
        whole.fit = False
        return [whole]
    out = [chunks[0].data]
    for k, c in enumerate(chunks[1:], 1):
        if k in wrong:
            out[-1] += c.data
        else:
            out.append(c.data)
    return fit_chunks(out)


class Pieces:
    """Encodes pieces of text: the ids of words met before are kept, the library gets only other words.

    Holds for files that normalize and split as NORMALIZED and SPLIT say, and for pieces of letters that
    composing leaves alone and whose small form is one letter; all other pieces go to the library.
    """

    def __init__(self, tokenizer, spec: dict, most: int = KEPT_WORDS) -> None:
        self.tokenizer, self.most = tokenizer, most
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.known = (
            [s.get("type") for s in steps] == NORMALIZED
            and (split.get("pattern") or {}).get("Regex") == SPLIT
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        )
        self.words: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _plain(self, text: str) -> bool:
        return self.known and not _OTHER.search(text) and not any(t in text for t in self.added)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split = [_WORDS.findall(t.lower()) if self._plain(t) else None for t in texts]
        slow = [k for k, words in enumerate(split) if words is None]
        new = list(set().union(*(w for w in split if w)).difference(self.words))
        if len(self.words) + len(new) > self.most:
            self.words = {}
            new = list(set().union(*(w for w in split if w)))
        self.words.update(zip(new, self.library(new), strict=True))
        known = self.words.__getitem__
        out = [b"" if words is None else b"".join(map(known, words)) for words in split]
        for k, ids in zip(slow, self.library([texts[k] for k in slow]), strict=True):
            out[k] = ids
        return out


@cache
def _encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file; one for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return Encoder(Pieces(tokenizer, json.loads(Path(path).read_text(encoding="utf-8"))))


@cache
def _tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id's token, from the file's own list."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    held = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens") or ()}
    return {i: t.encode("utf-8") for i, t in held.items()}


def encode_texts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n_tokens`` (long), ``ids`` (binary: unsigned 32-bit little-endian) and ``n_chunks``.

    The ids are those of ``tokenizers``' encode without special tokens added, for the whole text however
    long it is: a text goes in chunks, and a run of characters without a space of any length is one
    piece.  ``tokenizer`` is the path of a file that every executor has; its split must not match across
    white space (where it does, joins don't agree, and texts are encoded whole).  A null or empty text
    has no tokens.  Repeated rows and rows without a doc_id are treated like any other; an empty table
    gives an empty table; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                raw = [t.encode("utf-8") for t in part.column(1).to_pylist()]
                begins = np.cumsum([0, *map(len, raw)])[:-1].tolist()
                found = encoder(b"".join(raw), begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                        pa.array([ids for ids, _ in found], pa.binary()),
                        pa.array([n for _, n in found], pa.int64()),
                    ],
                    ["doc_id", "n_tokens", "ids", "n_chunks"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, n_chunks long")


def decode_ids(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The table with ``decoded``: what ``tokenizers``' decode makes of ``ids`` (packed as above).

    Of a file without a decoder that is the tokens with a space between; ids that the file doesn't have
    are left out.  Null ids give a null text, no ids an empty one.  Other columns stay, but for one named decoded.
    """

    table = encoded.drop("decoded")
    names = [*table.columns, "decoded"]
    place = table.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        # a text is some times as long as its ids: a few rows at a time
        for part in (b.slice(at, DECODED_ROWS) for b in batches for at in range(0, b.num_rows, DECODED_ROWS)):
            texts = [
                None if packed is None else b" ".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist() if i in tokens])
                for packed in part.column(place).to_pylist()
            ]
            decoded = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, decoded], names)

    return table.mapInArrow(run, StructType([*table.schema.fields, StructField("decoded", StringType())]))
