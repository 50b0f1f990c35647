"""Names of terms found in texts by an automaton: a trie of atoms with failure links.

An atom is a whole run of letters and digits, or one other character.  A name counts in a text where no
letter or digit touches it, that is where its atoms are the text's; so the automaton reads a text once, atom by
atom, and reports every name that ends there, names inside and at the start of others included.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable
from typing import NamedTuple

_ATOM = re.compile(r"[^\W_]+|[\W_]")
_WORD = re.compile(r"[^\W_]")


class Name(NamedTuple):
    """One name of a term; ``exact`` tells that case matters."""

    term: str
    text: str
    exact: bool = False


class _Trie:
    """States are numbers; 0 is the start.  Texts are read in the case that its names have."""

    def __init__(self) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.length = [0]
        self.terms: list[list[str]] = [[]]
        self.fail: list[int] = [0]
        #: The nearest state on the chain of failures that ends a name, 0 where there is none.
        self.shorter: list[int] = [0]

    def add(self, atoms: list[str], term: str) -> None:
        state = 0
        for atom in atoms:
            to = self.moves[state].get(atom)
            if to is None:
                to = self.moves[state][atom] = len(self.moves)
                self.moves.append({})
                self.terms.append([])
                self.length.append(self.length[state] + len(atom))
                self.fail.append(0)
                self.shorter.append(0)
            state = to
        if term not in self.terms[state]:
            self.terms[state].append(term)

    def link(self) -> None:
        """Sets failure links level by level, after the last name."""
        waiting = deque(self.moves[0].values())
        while waiting:
            state = waiting.popleft()
            for atom, to in self.moves[state].items():
                back = self.fail[state]
                while back and atom not in self.moves[back]:
                    back = self.fail[back]
                back = self.moves[back].get(atom, 0)
                self.fail[to] = back
                self.shorter[to] = back if self.terms[back] else self.shorter[back]
                waiting.append(to)

    def first_places(self, atoms: list[str], first: dict[str, int]) -> None:
        """Sets in ``first`` where each term found begins, unless it is there from further left."""
        moves, start = self.moves, self.moves[0]
        state = end = 0
        for k, atom in enumerate(atoms):
            end += len(atom)
            if state:
                while state and atom not in moves[state]:
                    state = self.fail[state]
                state = moves[state].get(atom, 0)
            else:
                state = start.get(atom, 0)
            at = state
            while at:
                if self.terms[at]:
                    place = end - self.length[at]
                    if self._free(atoms, k, at):
                        for term in self.terms[at]:
                            if place < first.get(term, place + 1):
                                first[term] = place
                at = self.shorter[at]

    def _free(self, atoms: list[str], k: int, state: int) -> bool:
        """Whether no letter or digit touches the name of ``state`` that ends with atom ``k``.

        Runs are whole, so that matters only for names that begin or end with another character.
        """
        if k + 1 < len(atoms) and not _WORD.match(atoms[k]) and _WORD.match(atoms[k + 1]):
            return False
        left, size = k, self.length[state]
        while size > 0:
            size -= len(atoms[left])
            left -= 1
        return left < 0 or bool(_WORD.match(atoms[left + 1])) or not _WORD.match(atoms[left])


class Automaton:
    """Finds the terms of texts by their names."""

    def __init__(self, names: Iterable[Name]) -> None:
        self.folded, self.exact = _Trie(), _Trie()
        for term, text, exact in names:
            text = " ".join(text.split())
            if text:
                (self.exact if exact else self.folded).add(_ATOM.findall(text if exact else fold(text)), term)
        self.folded.link()
        self.exact.link()

    def first_places(self, text: str) -> dict[str, int]:
        """Where each term that the text has begins first."""
        first: dict[str, int] = {}
        if len(self.folded.moves) > 1:
            self.folded.first_places(_ATOM.findall(fold(text)), first)
        if len(self.exact.moves) > 1:
            self.exact.first_places(_ATOM.findall(text), first)
        return first

    def leading(self, text: str, most: int) -> list[tuple[int, str]]:
        """(place, term) of the first ``most`` terms, ties by term."""
        return sorted((p, t) for t, p in self.first_places(text).items())[:most]


def fold(text: str) -> str:
    """Small letters, one for one, so that places stay; both small sigmas are one."""
    small = text.lower()
    if len(small) != len(text) or "Σ" in text:
        small = "".join(s if len(s := c.lower()) == 1 else c for c in text)
    return small.replace("ς", "σ")
