"""Citation marks ``[n]`` in text that arrives in pieces."""

from __future__ import annotations

import re

_MARK = re.compile(r"\[([0-9]+)\]")
_OPEN = re.compile(r"\[[0-9]{0,4}\Z")


def held_back(text: str) -> str:
    """The end of the text that may become a mark with what follows."""
    found = _OPEN.search(text)
    return found[0] if found else ""


def without_unknown(text: str, known: int) -> str:
    """The text without marks whose number isn't from 1 to ``known``."""
    return _MARK.sub(lambda m: m[0] if 1 <= int(m[1]) <= known else "", text)
