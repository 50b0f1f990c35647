"""Arrays, maps, vectors, JSON, digests, ids and cursors."""

from __future__ import annotations

import base64
import json
import unicodedata
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import _clean_lines, arrow_udf, squeeze

#: Namespace of the name-based ids; a parameter of every id function.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "vellum:corpus")
SEPARATOR = "\x1f"


# -- arrays ---------------------------------------------------------------------------------------
def distinct_folded(values: Column) -> Column:
    """Squeezed strings that aren't empty; of those that differ in case only the first stays."""
    clean = F.filter(F.transform(values, squeeze), lambda s: s != "")
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda s, i: F.array_position(keys, F.lower(s)) == i + 1)


def text_or_list(listed: Column, joined: Column, mark: str = "|") -> Column:
    """The array ``listed``, or where it is null the parts of ``joined``; empty parts go."""
    parts = F.split(F.coalesce(joined, F.lit("")), F.lit("\\" + mark))
    return F.filter(F.coalesce(listed, parts), lambda s: s.isNotNull() & (s != ""))


def with_legacy(listed: Column, single: Column) -> Column:
    """The array with ``single`` put in front if it isn't in it; empty and null entries go."""
    kept = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda s: s != "")
    front = F.coalesce(single, F.lit("")) != ""
    return F.when(front & ~F.array_contains(kept, single), F.concat(F.array(single), kept)).otherwise(
        kept
    )


def sum_values(counts: Column) -> Column:
    """Sum of a map's values; nulls count as 0."""
    zero = F.lit(0).cast("long")
    return F.aggregate(F.map_values(counts), zero, lambda a, v: a + F.coalesce(v, zero))


def adjacent_pairs(values: Column) -> Column:
    """Structs (first, second) of the entries 1 and 2, 3 and 4, …; an odd last entry goes."""
    pairs = F.floor(F.size(values) / 2).cast("int")
    at = F.when(pairs > 0, F.sequence(F.lit(1), F.greatest(pairs, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        at,
        lambda i: F.struct(
            F.element_at(values, 2 * i - 1).alias("first"), F.element_at(values, 2 * i).alias("second")
        ),
    )


# -- vectors --------------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def all_finite(vector: Column) -> Column:
    return F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    )


@arrow_udf("array<float>")
def unpacked(packed: pd.Series) -> pd.Series:
    """Little-endian float32 bytes as numbers; null where the length isn't a multiple of 4."""
    return packed.map(
        lambda b: np.frombuffer(b, "<f4") if len(b) % 4 == 0 else None, na_action="ignore"
    )


@arrow_udf("binary")
def packed(vectors: pd.Series) -> pd.Series:
    """Little-endian float32 bytes."""
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


def from_base64(text: Column) -> Column:
    """The vector of base64 text; null where it can't be read."""
    return unpacked(F.try_to_binary(text, F.lit("base64")))


# -- JSON and ids ---------------------------------------------------------------------------------
def _tidy(value):
    if isinstance(value, str):
        return _clean_lines(value)
    if isinstance(value, dict):
        return {k: _tidy(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_tidy(v) for v in value]
    return value


@arrow_udf("string")
def canonical_json(texts: pd.Series) -> pd.Series:
    """The same value with sorted keys, no spaces and cleaned strings; null where it isn't JSON."""

    def one(text: str) -> str | None:
        try:
            value = _tidy(json.loads(text))
            return json.dumps(
                value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False
            )
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def name_uuid(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The UUID of version 5 of a name: SHA-1 with six bits set, all in the JVM."""
    space = F.unhex(F.lit(namespace.hex))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def version_id(kind: str, *parts: Column) -> Column:
    """An id that follows from content: equal parts, equal id."""
    digest = F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts]), 256)
    return name_uuid(F.concat_ws(SEPARATOR, F.lit(kind), digest))


def sealed(record: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct, to be stored beside it."""
    return F.sha2(canonical_json(F.to_json(record, {"ignoreNullFields": "false"})), 256)


# -- cursors --------------------------------------------------------------------------------------
def cursor(moment: Column, row_id: Column) -> Column:
    """An opaque page mark: unpadded URL-safe base64 of JSON with the last row's sort key."""
    body = F.to_json(
        F.struct(
            F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"),
            row_id.cast("string").alias("id"),
        )
    )
    return F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def read_cursor(mark: str) -> tuple[str, str]:
    """(moment, id) of a page mark; ValueError where it isn't one."""
    try:
        body = json.loads(base64.urlsafe_b64decode(mark + "=" * (-len(mark) % 4)))
        moment, row_id = body["t"], body["id"]
    except (ValueError, KeyError, TypeError) as problem:
        raise ValueError("this is no page mark") from problem
    if not (isinstance(moment, str) and isinstance(row_id, str)):
        raise ValueError("this is no page mark")
    return moment, row_id


@arrow_udf("string")
def printable_problem(texts: pd.Series) -> pd.Series:
    """The first character of a kind that clean text hasn't: control, private use, replacement."""

    def one(text: str) -> str | None:
        for c in text:
            if c == "�" or (c not in "\n\t" and unicodedata.category(c) in ("Cc", "Co")):
                return f"U+{ord(c):04X}"
        return None

    return texts.map(one, na_action="ignore")
