"""Hashed word n-grams of texts by the algebra of CRCs, without a string of an n-gram.

The CRC-32 of a text that continues another is linear in the first one's: with ``A`` and ``B`` byte strings,
``crc(A + B) = Z^len(B) crc(A) ^ crc(B)``, where ``Z`` is the matrix over GF(2) that one zero byte
applies to the register.  So the CRC of every word is computed once, from its bytes, and that of an
n-gram follows from the CRC of the n-gram before it and that of its last word, by a table look-up of
``Z^length``.

Texts come as one array of bytes with the places where they begin; all steps are numpy's over blocks of
bounded size.  A text may be cut at a byte outside words; the last words of a block go on into the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np

#: The reversed polynomial of CRC-32 (a fixed value of the standard).
POLYNOMIAL = 0xEDB88320
#: Lengths whose shift is one look-up in each of four tables; longer ones multiply by squared matrices.
SHORT = 256
#: Words up to so many bytes get their CRC from tables of byte and place; longer ones from zlib.
WORD_BYTES = 64
#: Bytes of text in a block.
BLOCK = 1 << 17


def _byte_table() -> np.ndarray:
    """The register after one byte, for each value of the register's low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


BYTES = _byte_table()


def zero_byte(register: np.ndarray) -> np.ndarray:
    """``Z`` applied to registers: what one zero byte makes of them."""
    return (register >> np.uint32(8)) ^ BYTES[register & np.uint32(255)]


def _tables_of(columns: np.ndarray) -> np.ndarray:
    """Four tables of 256 products for the matrix whose columns are the images of the 32 bits."""
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            with_bit = np.arange(256) >> bit & 1 == 1
            tables[k, with_bit] ^= columns[8 * k + bit]
    return tables


def _apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The matrix of ``tables`` times registers."""
    out = tables[0][register & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][register >> np.uint32(8 * k) & np.uint32(255)]
    return out


class Shifts:
    """Products of registers with ``Z^length``."""

    def __init__(self) -> None:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        short = []
        for _ in range(SHORT):
            short.append(_tables_of(columns))
            columns = zero_byte(columns)
        # of each length below SHORT, flat: table k of length n begins at (4 n + k) * 256
        self.short = np.concatenate([t.ravel() for t in short])
        # Z^SHORT, its square, ...: one for each bit of length // SHORT
        self.squares = [_tables_of(columns)]

    def _square(self, k: int) -> np.ndarray:
        while len(self.squares) <= k:
            last = self.squares[-1]
            self.squares.append(_tables_of(_apply(last, _apply(last, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
        return self.squares[k]

    def __call__(self, register: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = (length % SHORT) << 10
        out = self.short[at + (register & np.uint32(255))]
        for k in (1, 2, 3):
            out ^= self.short[at + (k << 8) + (register >> np.uint32(8 * k) & np.uint32(255))]
        far = np.flatnonzero(length >= SHORT)
        if far.size:
            rest, moved, k = length[far] // SHORT, out[far], 0
            while rest.any():
                odd = rest & 1 == 1
                moved[odd] = _apply(self._square(k), moved[odd])
                rest, k = rest >> 1, k + 1
            out[far] = moved
        return out


def _place_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte with ``d`` bytes of its word after it adds to the CRC, and what a length adds."""
    images = np.empty((WORD_BYTES, 256), np.uint32)
    start = np.empty(WORD_BYTES + 1, np.uint32)
    images[0], start[0] = BYTES, 0xFFFFFFFF
    for d in range(1, WORD_BYTES):
        images[d] = zero_byte(images[d - 1])
    for n in range(1, WORD_BYTES + 1):
        start[n] = zero_byte(start[n - 1 : n])[0]
    return images.ravel(), start ^ np.uint32(0xFFFFFFFF)


def _lower() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _word_bytes() -> np.ndarray:
    """Digits, small letters and all bytes of characters beyond ASCII make words."""
    held = np.zeros(256, bool)
    held[48:58] = held[97:123] = held[128:] = True
    return held


#: The tables are built once per Python worker.
_shifts, _places = cache(Shifts), cache(_place_tables)


class Grams:
    """CRCs of the word n-grams of texts."""

    def __init__(self, most: int = 3) -> None:
        self.most = most
        self.shift = _shifts()
        self.images, self.starts = _places()
        self.lower, self.is_word = _lower(), _word_bytes()
        self.space = np.uint32(zlib.crc32(b" "))

    def _word_crcs(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The CRC of each word; ``held`` marks the bytes of words, which follow word by word."""
        places = np.flatnonzero(held)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ends = np.repeat(begins + lengths - 1, lengths)
        after = ends - places
        near = after < WORD_BYTES
        parts = np.where(near, self.images[np.where(near, after, 0) * 256 + data[places]], np.uint32(0))
        crcs = np.bitwise_xor.reduceat(parts, first) ^ self.starts[np.minimum(lengths, WORD_BYTES)]
        for k in np.flatnonzero(lengths > WORD_BYTES):
            crcs[k] = zlib.crc32(data[begins[k] : begins[k] + lengths[k]])
        return crcs

    def _cuts(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Blocks of at most BLOCK bytes, cut outside words (longer only for a longer word)."""
        at = 0
        while at < len(data):
            end, size = min(at + BLOCK, len(data)), BLOCK
            while end < len(data):
                outside = np.flatnonzero(~self.is_word[data[max(at, end - size) : end]])
                if outside.size:
                    end = max(at, end - size) + int(outside[-1]) + 1
                    break
                # no cut in the block: go on until the word ends
                more = np.flatnonzero(~self.is_word[data[end : end + BLOCK]])
                end = end + int(more[0]) + 1 if more.size else min(end + BLOCK, len(data))
                size = 1
            yield at, end
            at = end

    def __call__(self, raw: bytes, begins: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Blocks of words: the text of each word, then for n = 1, 2, ... the CRCs of the n-grams that
        end with it and whether the text has that many words by then.

        Text ``k`` starts at ``begins[k]`` of ``raw``; the texts follow one another.
        """
        data = np.frombuffer(raw.translate(self.lower), np.uint8)
        begins = np.asarray(begins, np.int64)
        kept = self.most - 1
        crc0, len0, text0 = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        for at, end in self._cuts(data):
            part = data[at:end]
            held = self.is_word[part]
            starts = held.copy()
            starts[1:] &= ~held[:-1]
            inside = begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at
            starts[inside] = held[inside]
            stops = np.zeros(len(part) + 1, bool)
            stops[1:] = held
            stops[:-1] &= ~held
            stops[inside[inside > 0]] |= held[inside[inside > 0] - 1]
            first = np.flatnonzero(starts)
            if not first.size:
                continue
            size = np.flatnonzero(stops) - first
            crc = np.concatenate([crc0, self._word_crcs(part, first, size, held)])
            length = np.concatenate([len0, size])
            text = np.concatenate([text0, np.searchsorted(begins, first + at, side="right") - 1])
            new = len(crc0)
            grams, whole = [crc], [np.ones(len(crc), bool)]
            spaced = self.shift(np.full(len(crc), self.space), length) ^ crc
            for n in range(2, self.most + 1):
                longer, same = crc.copy(), np.zeros(len(crc), bool)
                if len(crc) >= n:
                    longer[1:] = self.shift(grams[-1][:-1], length[1:] + 1) ^ spaced[1:]
                    same[n - 1 :] = text[n - 1 :] == text[: len(text) - n + 1]
                grams.append(longer)
                whole.append(same)
            yield text[new:], [g[new:] for g in grams], [w[new:] for w in whole]
            crc0, len0, text0 = (x[len(x) - min(kept, len(x)) :] for x in (crc, length, text))
