"""Token counts: count-only Viterbi segmentation with a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character, the longest first; the
dynamic program keeps the best score and that path's number of pieces, never the path.  Of equal
scores the piece that starts first stays, which is the tokenizer's rule.  No piece of the vocabulary
goes on over a space mark after another character, so the best path of a text is made of the best
paths of its words, and the counts of words met before are kept in a bounded table of the task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame

from vellum.llm.common import documents, map_columns

#: The sentencepiece file whose pieces and scores make the vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Below the least score of the vocabulary: the score of a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task keeps; the table starts anew when it is full.
CACHE_WORDS = 400_000
#: Longer words aren't kept.
CACHE_CHARS = 64

_NONE = float("-inf")

_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``bytes_known`` tells that every byte has a piece."""

    scores: dict[str, float]
    bytes_known: bool

    @property
    def unknown(self) -> float:
        return min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The normal pieces of a sentencepiece file; control and unknown pieces never match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in ids
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }
    return Vocabulary(scores, sum(model.is_byte(i) for i in ids) == 256)


class Counter:
    """Counts the pieces of texts; holds the automaton and the counts of words seen."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.vocabulary, self.unknown = vocabulary, vocabulary.unknown
        self.singles = {p for p in vocabulary.scores if len(p) == 1}
        across = any(MARK in p.lstrip(MARK) for p in vocabulary.scores)
        # where pieces go on over marks, the whole text is one word
        self.words = re.compile(rf"(?s){MARK}*[^{MARK}]+|{MARK}+" if not across else r"(?s).+")
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def _unknown_pieces(self, run: str) -> int:
        """Pieces of a run of unknown characters: its bytes, or one unknown piece."""
        return len(run.encode("utf-8", "surrogatepass")) if self.vocabulary.bytes_known else 1

    def viterbi(self, word: str) -> int:
        """The number of pieces of the best segmentation."""
        n = len(word)
        best = [_NONE] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        if self.singles.issuperset(word):
            # matches come by their end, the longest first, so of equal scores the first stays
            for end, (length, score) in self.automaton.iter(word):
                start = end + 1 - length
                total = best[start] + score
                if total > best[end + 1]:
                    best[end + 1], count[end + 1] = total, count[start] + 1
            return count[n]
        # of a path that ends in unknown characters: where their run starts
        run = list(range(n + 1))

        def unknown(at: int) -> None:
            total = best[at] + self.unknown
            if word[at] not in self.singles and total > best[at + 1]:
                first = run[at]
                best[at + 1], run[at + 1] = total, first
                count[at + 1] = count[first] + self._unknown_pieces(word[first : at + 1])

        done = 0
        for end, (length, score) in self.automaton.iter(word):
            while done < end:
                unknown(done)
                done += 1
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[start] + 1
        while done < n:
            unknown(done)
            done += 1
        return count[n]

    def __call__(self, text: str) -> int:
        """The number of tokens of a text: a mark stands before it and for each of its spaces."""
        if not text:
            return 0
        words = self.words.findall(MARK + text.replace(" ", MARK))
        cache = self.cache
        new = set(words).difference(cache)
        if not new:
            return sum(map(cache.__getitem__, words))
        if len(cache) + len(new) > self.cache_words:
            cache.clear()
            new = set(words)
        long = {}
        for word in new:
            (cache if len(word) <= CACHE_CHARS else long)[word] = self.viterbi(word)
        if not long:
            return sum(map(cache.__getitem__, words))
        return sum(long[w] if w in long else cache[w] for w in words)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_words``, ``n_code_points`` (long) of every whole text.

    The tokens are those of the unigram model with the vocabulary's pieces and scores, byte pieces
    standing for characters that no piece covers.  ``vocabulary`` is a path that every executor
    has; of a file made for another segmentation (the default one is a BPE file) only pieces and scores
    count, and the counts are those of the unigram model on them, not of that file's own tokenizer.
    A null or empty text has no tokens; a text of any length is counted whole.  Repeated rows and rows without a doc_id are treated like any
    other; an empty table gives an empty table; other columns are ignored.
    """

    def make():
        counter = Counter(read_vocabulary(vocabulary))

        def run(ids, texts):
            return (
                ids,
                [counter(t) for t in texts],
                [len(t.split()) for t in texts],
                [len(t) for t in texts],
            )

        return run

    return map_columns(
        documents(docs), make, "doc_id long, n_tokens long, n_words long, n_code_points long"
    )
