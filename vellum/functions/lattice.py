"""Words that a page broke into parts: the cheapest way through a lattice of possible joins.

Between the parts of a run of letters, each one space apart, every join of neighbours that the lexicon has is an
edge, and every part by itself another.  The repaired text is the cheapest path: a word of the lexicon costs what
the lexicon says, a part that is none (or never stands alone) costs UNKNOWN, and each join costs JOIN, a little
more than a word, so that two good words aren't made into one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a join and a part without a word cost, where a word of a plain list costs 1; parts of one word at most.
JOIN, UNKNOWN, MOST_PARTS = 1.01, 3.0, 8
_RUN = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)+")


class Lattice:
    """Joins the parts of runs by a lexicon.

    ``lexicon`` are words, or words with costs; ``never_alone`` are parts that are no words by themselves even if
    the lexicon has them; of ``exclusions`` (pairs of parts) no two neighbours are joined.  All in any case.
    """

    def __init__(self, lexicon: Iterable[str] | Mapping[str, float], never_alone: Iterable[str] = (), exclusions: Iterable[tuple[str, str]] = ()) -> None:
        costs = lexicon.items() if isinstance(lexicon, Mapping) else ((w, 1.0) for w in lexicon)
        self.costs = {w.lower(): float(c) for w, c in costs}
        self.alone = self.costs.keys() - {p.lower() for p in never_alone}
        self.excluded = {(a.lower(), b.lower()) for a, b in exclusions}
        self.longest = max(map(len, self.costs), default=0)

    def edges(self, parts: list[str], at: int, free_end: bool) -> Iterator[tuple[int, float]]:
        """(number of parts, cost) of the words that may begin with part ``at``.

        A capital letter alone is a name or unit and ends no joined word; nor does the last part where what
        follows it in the text (a digit, a hyphen) makes it the start of something else.
        """
        word = parts[at].lower()
        yield 1, self.costs[word] if word in self.alone else UNKNOWN
        for k in range(2, min(MOST_PARTS, len(parts) - at) + 1):
            last = parts[at + k - 1]
            if (parts[at + k - 2].lower(), last.lower()) in self.excluded:
                return
            word += last.lower()
            if len(word) > self.longest:
                return
            capital = len(last) == 1 and last.isupper()
            if word in self.costs and not capital and (free_end or at + k < len(parts)):
                yield k, self.costs[word] + JOIN * (k - 1)

    def words(self, parts: list[str], free_end: bool = True) -> list[str]:
        """The parts joined along the cheapest path; of equal ones that with fewer joins, then with the shorter
        words first."""
        best: list[tuple] = [(0.0, 0, ())] * (len(parts) + 1)
        for at in range(len(parts) - 1, -1, -1):
            ways = []
            for k, cost in self.edges(parts, at, free_end):
                rest = best[at + k]
                ways.append((round(cost + rest[0], 9), k - 1 + rest[1], (k, rest[2])))
            best[at] = min(ways)
        out, at, chain = [], 0, best[0][2]
        while chain:
            k, chain = chain
            out.append("".join(parts[at : at + k]))
            at += k
        return out

    def repaired(self, text: str) -> str:
        """The text with the parts of its runs joined."""

        def joined(m: re.Match) -> str:
            after = text[m.end() : m.end() + 1]
            return " ".join(self.words(m[0].split(" "), not (after.isdigit() or after == "-")))

        return _RUN.sub(joined, text)


def joined_syllables(
    lexicon: list[str] | dict[str, float], never_alone: tuple[str, ...] = (), exclusions: tuple[tuple[str, str], ...] = ()
) -> Column:
    """Arrow UDF: text with split words joined, however many parts a word has; null stays null.

    The lexicon is a bounded list, or words with costs.
    """

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(lexicon, never_alone, exclusions)
        for texts in batches:
            yield texts.map(lattice.repaired, na_action="ignore")

    return join
