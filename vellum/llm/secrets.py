"""Secret scans: plain patterns, and linking of the parts of multipart credentials.

Assignments, access identifiers and long hex runs are reported as they are.  A token that merely
looks random is a weak candidate: it counts only if its scope (the interval around it) meets the
intervals of complementary parts: an identifier (an access id or a named one) or the endpoint of a service,
which is a named field, a data store's address, an address with a user in it, or a host that is called like a
service.  Any other link is no part of a credential.  The parts of a text are sorted by place, and each weak
token finds its partners by an interval join over those lists; the token and all of them are one set.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from vellum.llm.common import documents, map_columns

#: Code points around a weak token in which its partner has to lie, and the token's least entropy.
SCOPE, ENTROPY = 200, 3.5

KINDS = ("assign", "access", "hex", "identifier", "endpoint", "token")
_KEYWORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
# a run's later parts are no matches of their own, so the lengths can stand in the patterns
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
_IDENTIFIER = re.compile(
    r"(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*"
    r"[\"']?[\w.@+-]{3,}",
    re.IGNORECASE | re.ASCII,
)
#: Words of fields and first names of hosts that stand for a service, and schemes of data stores: fixed values.
_FIELDS = "endpoint|hostname|host|server|base_?url|api_?url|service_?url|db_?url|database_?url|dsn|bucket"
_SERVICES = "api|auth|oauth|sso|login|db|sql|vault|queue|broker|gateway|registry|git|hooks?|webhooks?|s3|storage|smtp|imap|ldap"
_STORES = "postgres(?:ql)?|mysql|mariadb|mongodb(?:\\+srv)?|rediss?|amqps?|mssql|ldaps?|s?ftp|ssh|s3|gs|smtp"
_ENDPOINT = re.compile(
    rf"(?<![a-z0-9])(?:{_FIELDS})[\"']?\x20*[:=]\x20*[\"']?[a-z0-9][\w.:/@?&%+-]{{3,}}"
    rf"|\b(?:{_STORES})://[^\s\"'<>]{{4,}}"
    rf"|\b[a-z][a-z0-9+]{{1,15}}://(?:[^\s/\"'<>@:]+:[^\s/\"'<>@]+@|(?:{_SERVICES})[0-9]*[.:-])[^\s\"'<>]{{3,}}",
    re.IGNORECASE | re.ASCII,
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain findings, by start, then kind."""
    out = []
    folded = text.lower()
    if any(k in folded for k in _KEYWORDS):
        out += [
            (m.start(), m.end(), "assign")
            for m in _ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= 6
        ]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(token: str) -> float:
    """Bits per character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _random_looking(token: str) -> bool:
    return (
        any(c.isdigit() for c in token)
        and any(c.isupper() for c in token)
        and any(c.islower() for c in token)
        and entropy(token) >= ENTROPY
    )


def _meeting(parts: list[tuple[int, int, str]], start: int, end: int) -> list[tuple]:
    """The parts that meet the interval; they don't overlap each other and are sorted."""
    at = bisect_left(parts, start, key=lambda p: p[1])
    out = []
    while at < len(parts) and parts[at][0] < end:
        out.append(parts[at])
        at += 1
    return out


def links(text: str, base: list[tuple[int, int, str]]) -> list[list[tuple]]:
    """Sets of a weak token, first, and all complementary parts whose intervals its scope meets."""
    flat = _flat(base)
    weak = [
        (m.start(), m.end(), "token")
        for m in _TOKEN.finditer(text)
        if _random_looking(m[0]) and not _meeting(flat, m.start(), m.end())
    ]
    if not weak:
        return []
    access = [s for s in base if s[2] == "access"]
    named = [(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text)]
    endpoints = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    sets = []
    for token in weak:
        near = [p for kind in (access, named, endpoints) for p in _meeting(kind, token[0] - SCOPE, token[1] + SCOPE)]
        parts = [p for p in near if p[1] <= token[0] or p[0] >= token[1]]
        if parts:
            sets.append([token, *parts])
    return sets


def complete(found: list[tuple]) -> bool:
    """Whether a set has a secret, an identifier and an endpoint."""
    kinds = {k for *_, k in found}
    return "endpoint" in kinds and bool(kinds & {"access", "identifier"})


def _flat(base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The union of base spans, of which those of different kinds may overlap: sorted and disjoint."""
    flat: list[tuple[int, int, str]] = []
    for s, e, _ in base:
        if flat and s < flat[-1][1]:
            flat[-1] = (flat[-1][0], max(e, flat[-1][1]), "")
        else:
            flat.append((s, e, ""))
    return flat


def linked_spans(sets: list[list[tuple]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The tokens and parts of the sets; parts that meet a base span excepted."""
    flat = _flat(base)
    parts = {p for _, *rest in sets for p in rest if p[2] != "access" and not _meeting(flat, p[0], p[1])}
    return [*{s[0] for s in sets}, *parts]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text, one row per row of ``docs``.

    Columns: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_linked``, ``n_complete`` (sets with a
    secret, an identifier and an endpoint; long), ``base_sha256`` (of the plain findings), ``spans`` (all findings
    as kind:start:end by start, then kind; code points, end exclusive), ``links`` (of each weak token that met
    parts token:start:end+kind:start:end+…, comma-joined).  A null or empty text has none; texts of any length are
    read whole, in time that grows with the length.  Repeated rows and rows without a doc_id are treated like any
    other; an empty table gives an empty table; other columns are ignored.
    """

    def make():
        def run(ids, texts):
            out = []
            for text in texts:
                base = base_spans(text)
                sets = links(text, base)
                linked = linked_spans(sets, base)
                spans = sorted(base + linked, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                n = Counter(k for *_, k in base)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                together = ",".join("+".join(f"{k}:{s}:{e}" for s, e, k in one) for one in sets)
                out.append((n["assign"], n["access"], n["hex"], len(linked), sum(map(complete, sets)), digest, _joined(spans), together))
            return [ids, *map(list, zip(*out, strict=True))]

        return run

    return map_columns(
        documents(docs),
        make,
        "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, n_complete long, "
        "base_sha256 string, spans string, links string",
    )
