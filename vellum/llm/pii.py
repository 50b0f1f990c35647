"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Context words are those of four languages; they count on either side of a span, the more the nearer they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame

from vellum.llm.common import documents, map_columns

#: Code points on either side of a span that are searched for context words, and what a word right beside it
#: adds to the score; at the far end it adds half of that.
CONTEXT, BONUS = 40, 0.3
#: Added spans need this score; base spans stay whatever theirs is.
LEAST_SCORE = 0.6

KINDS = ("email", "ip", "card", "phone", "iban", "national_phone", "ssn", "amex")
#: Score of a span that its validator confirms, without context.
SCORES = {
    "email": 0.7,
    "ip": 0.6,
    "card": 0.7,
    "phone": 0.6,
    "iban": 0.7,
    "national_phone": 0.45,
    "ssn": 0.45,
    "amex": 0.7,
}
#: Context words in English, French, German and Spanish: fixed values.
_PHONE_WORDS = (
    "phone tel telephone call mobile cell fax téléphone tél portable appelez appel numéro telefon handy rufnummer anrufen "
    "teléfono móvil celular llame llamar"
)
_CARD_WORDS = "card visa mastercard amex credit payment carte crédit paiement karte kreditkarte zahlung tarjeta crédito pago"
WORDS = {
    "email": "email e-mail mail contact courriel adresse correo contacto kontakt",
    "ip": "ip address host server adresse serveur hôte dirección servidor",
    "card": _CARD_WORDS,
    "phone": _PHONE_WORDS,
    "iban": "iban account bank compte banque konto bankverbindung cuenta banco",
    "national_phone": _PHONE_WORDS,
    "ssn": "ssn social sécurité sociale sozialversicherung sozialversicherungsnummer seguridad",
    "amex": _CARD_WORDS,
}
_NEAR = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, w.split())) + r")\b") for k, w in WORDS.items()}
#: Characters of an account number by country: fixed values of the public registry.
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits is tried once, from its start: its later starts can't match where that fails
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# may run on into what follows the number; a last group may have one character
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?:\x20?[A-Z0-9])?")
_GROUP_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Cards of 15 digits, which the base kind doesn't take.
_AMEX = re.compile(r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])")


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
            done = found.end()
        at = text.find("@", at + 1)
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    return [
        m.span()
        for m in _CARD.finditer(text)
        if m.end() - m.start() >= 16
        and 16 <= len(d := _digits(m[0])) <= 19
        and luhn(d)
    ]


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers: the groups from a start that have the country's length and that the check confirms."""
    out, m = [], _IBAN.search(text)
    while m:
        start, done = m.start(), m.start() + 1
        ends = [e.start() for e in _GROUP_END.finditer(text, start, m.end() + 1) if e.start() <= m.end()]
        size = IBAN_CHARS.get(m[0][:2])
        for end in reversed(ends):
            if len(c := text[start:end].replace(" ", "")) == size and mod97(c):
                out.append((start, end))
                done = end
                break
        m = _IBAN.search(text, done)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by kind, then start."""
    out = [(*s, "email") for s in _emails(text)]
    if text.count(".") >= 3:
        out += [
            (*m.span(), "ip")
            for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
        ]
    out += [(*s, "card") for s in _cards(text)]
    if "+" in text:
        out += [
            (*m.span(), "phone") for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15
        ]
    return out


def score(text: str, start: int, end: int, kind: str) -> float:
    """The kind's score, and what the nearest context word on either side adds."""
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    gaps = [len(before) - m.end() for m in _NEAR[kind].finditer(before)]
    first = _NEAR[kind].search(after)
    if first:
        gaps.append(first.start())
    return min(1.0, SCORES[kind] + (BONUS * (1 - min(gaps) / (2 * CONTEXT)) if gaps else 0))


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further kinds that score enough; but for a confirmed iban they must meet no base span."""
    found = [(*s, "iban") for s in _ibans(text) if score(text, *s, "iban") >= LEAST_SCORE]
    # base spans of different kinds may overlap: the furthest end up to each start
    starts = sorted((s, e) for s, e, _ in base)
    ends = list(accumulate((e for _, e in starts), max))
    for kind, pattern in (("national_phone", _NATIONAL), ("ssn", _SSN), ("amex", _AMEX)):
        for m in pattern.finditer(text):
            before = bisect_left(starts, (m.end(),))
            if before and ends[before - 1] > m.start():
                continue
            if kind == "amex" and not luhn(_digits(m[0])):
                continue
            if score(text, *m.span(), kind) >= LEAST_SCORE:
                found.append((*m.span(), kind))
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data of every whole text, one row per row of ``docs``.

    Columns: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``n_added`` (long),
    ``base_sha256``, ``spans`` (kind:start:end by kind, then start; code points, end exclusive),
    ``scores`` (of the spans, in their order) and ``top_score`` (null without spans).  Base kinds are email, ip,
    card (Luhn) and phone; iban (mod 97 and the country's length), national_phone, ssn and amex (Luhn) are
    added, national_phone and ssn only with a context word near them, all but iban only where they meet no base
    span.  A null or empty text has none; texts of any length are read whole.  Repeated rows and rows without a doc_id are treated like any other; an empty table gives an empty
    table; other columns are ignored.
    """

    def make():
        def run(ids, texts):
            out = []
            for text in texts:
                base = base_spans(text)
                added = added_spans(text, base)
                spans = sorted(base + added, key=lambda s: (KINDS.index(s[2]), s[0]))
                n = Counter(k for *_, k in base)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                scores = [score(text, s, e, k) for s, e, k in spans]
                counts = [n[k] for k in KINDS[:4]]
                out.append((*counts, len(added), digest, _joined(spans), ",".join(f"{x:.2f}" for x in scores), max(scores, default=None)))
            return [ids, *map(list, zip(*out, strict=True))]

        return run

    return map_columns(
        documents(docs),
        make,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, "
        "base_sha256 string, spans string, scores string, top_score double",
    )
