"""Toxicity by weak supervision.

Voters are words of a fixed lexicon, stems that a labelled sample shows to go with toxicity, a few
patterns, and numbers of such words in a text; each votes or abstains.  The label at hand is one more
voter, which may err and abstains on most texts.  A generative model of the votes estimates by EM, on
labelled and unlabelled texts alike, how often each voter fires on toxic and on clean texts and, in
each round anew, how far voters fire together beyond what the class explains; those share their weight.
A logistic regression on the presence of the voters is then trained on the posterior labels of the
texts that have a label, or of all where none has, and scores every text.  Without any label the votes
of the lexicon and the patterns alone make the model.  The fit takes bounded samples of rows; scoring
covers all texts and needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import documents, map_columns, saved, small_batches

#: Documents with and without a label that the fit takes at most, by hash of the id; stems of toxic rows
#: that are looked at, the commonest first, and stems that become voters.
SAMPLE_ROWS, UNLABELLED_ROWS, STEMS, STEM_VOTERS = 20_000, 10_000, 20_000, 400
#: Toxic rows that hold a stem at least, and how much likelier it is in toxic rows.
STEM_ROWS, STEM_LIFT = 4, 8.0
STEM_LENGTHS = (4, 5, 6)
#: Words whose voters a task keeps.
CACHE_WORDS = 400_000
THRESHOLD = 0.7
#: Rounds of EM; correlation of two voters within a class that is taken for chance; the label's least
#: error rate, and rows' worth of belief in it.
ROUNDS, CHANCE, LABEL_ERROR, BELIEF = 15, 0.1, 0.1, 10
#: Of rows without votes enough, the share that is toxic at first.
PRIOR = 0.1

#: Common insults of several languages: fixed values.
LEXICON = (
    "idiot stupid moron loser trash scum pathetic disgusting worthless clown dumb imbecile "
    "bastard jerk hateful filth vermin idiota imbécil estúpido basura asqueroso inútil patético "
    "idiote imbécile stupide ordure minable crétin dégoûtant dummkopf trottel abschaum widerlich "
    "wertlos erbärmlich dumm"
).split()
PATTERNS = {
    "/exclaiming": re.compile(r"!{3}"),
    "/masked": re.compile(r"[A-Za-z][*@#$]{2}"),
    "/shouting": re.compile(r"[A-Z]{4}"),
}
#: Voters that fire where so many distinct words of a text name other voters.
COUNTS = {"/words2": 2, "/words4": 4, "/words7": 7}
_WORD = re.compile(r"[^\W\d_]+")


def stems_of(word: str) -> list[str]:
    return [word, *(word[:k] for k in STEM_LENGTHS if len(word) > k)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Voters:
    """Finds which voters fire on a text; a voter is a word, a stem or the name of a pattern."""

    def __init__(self, names: list[str]):
        self.names = names
        self.number = {n: k for k, n in enumerate(names)}
        self.patterns = [(self.number[n], p) for n, p in PATTERNS.items() if n in self.number]
        self.counts = [(self.number[n], k) for n, k in COUNTS.items() if n in self.number]
        self.cache: dict[str, tuple[int, ...]] = {}

    def fired(self, text: str) -> list[int]:
        out = {k for k, p in self.patterns if p.search(text)}
        cache, number, telling = self.cache, self.number, 0
        for word in words_of(text):
            found = cache.get(word)
            if found is None:
                found = tuple(number[s] for s in stems_of(word) if s in number)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[word] = found
            if found:
                out.update(found)
                telling += 1
        out.update(k for k, least in self.counts if telling >= least)
        return sorted(out)


def may_learn(doc_id):
    """Rows whose label may be learned from: crc32 of the id's text isn't 1 modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def _some(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the rows, by hash of their doc_id.

    Of a larger table about twice as many are kept by hash first, so that what is sorted is bounded.
    """
    every = rows.count()
    if every > 2 * most:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("some"), "doc_id"), F.lit(every)) < 2 * most)
    return rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text``, ``toxic`` (null without a label) of the documents that the fit takes, one row of each.

    At most SAMPLE_ROWS with a label that may be learned from and UNLABELLED_ROWS others.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .filter(may_learn(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    given = saved(_some(known, SAMPLE_ROWS), "given")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    others = _some(ids, UNLABELLED_ROWS).join(F.broadcast(given), "doc_id", "left_anti")
    sample = saved(given.unionByName(others.withColumn("toxic", F.lit(None).cast("int"))), "sample-ids")
    rows = documents(docs).join(F.broadcast(sample), "doc_id")
    # of rows that share an id one, so that the bound holds for rows as well
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """``stem``, ``n``: rows that hold each (wanted) stem, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = {s for w in words_of(text) for s in stems_of(w)}
                seen.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_pydict(
            {"stem": pa.array(list(seen), pa.string()), "n": pa.array(seen.values(), pa.int64())}
        )

    counts = small_batches(rows).select("text").mapInArrow(run, "stem string, n long")
    return counts.groupBy("stem").agg(F.sum("n").alias("n"))


def stem_voters(rows: DataFrame) -> list[str]:
    """Stems that go with toxicity in the sample, the most telling first."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return []
    common = (
        _counted(rows.filter("toxic = 1"), None)
        .filter(F.col("n") >= STEM_ROWS)
        .orderBy(F.desc("n"), "stem")
        .limit(STEMS)
        .collect()
    )
    toxic = {r["stem"]: r["n"] for r in common}
    clean = {
        r["stem"]: r["n"] for r in _counted(rows.filter("toxic = 0"), set(toxic)).collect()
    }

    def lift(s: str) -> float:
        return toxic[s] / sizes[1] / ((clean.get(s, 0) + 0.5) / (sizes[0] + 1))

    good = [s for s in toxic if lift(s) >= STEM_LIFT]
    return sorted(good, key=lambda s: (-toxic[s] * np.log(lift(s)), s))[:STEM_VOTERS]


def shared_weight(votes: np.ndarray, rows: np.ndarray, post: np.ndarray, rate: list[np.ndarray]) -> np.ndarray:
    """Each voter's weight: one over its excess correlations within the classes, its own included."""
    together = np.zeros((votes.shape[1], votes.shape[1]))
    for p, r in ((post, rate[0]), (1 - post, rate[1])):
        rest = (votes - r) * np.sqrt(rows * p)[:, None]
        together += rest.T @ rest
    spread = np.sqrt(np.diag(together)) + 1e-9
    excess = np.maximum(together / np.outer(spread, spread) - CHANCE, 0) / (1 - CHANCE)
    np.fill_diagonal(excess, 1)
    return 1 / excess.sum(axis=0)


def label_posterior(votes: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """P(toxic) of each row of the 0/1 matrix ``votes`` under a generative model of the voters.

    ``labels`` are 0, 1 or -1 (none); ``rows`` tells how often each row stands for.  The model starts
    from the majority of votes and label; EM goes over the voters' firing rates in both classes,
    their correlations within the classes, the class share and the label's error rates.
    """
    votes = votes.astype(np.float64)
    rows = np.ones(len(votes)) if rows is None else rows.astype(np.float64)
    several = votes.sum(axis=1) >= 2
    post = np.where(labels == 1, 1 - PRIOR, np.where((labels < 0) & several, 1 - PRIOR, PRIOR))
    for _ in range(rounds):
        share = np.average(post, weights=rows)
        rate = [(votes.T @ (rows * p) + 0.5) / ((rows * p).sum() + 1) for p in (post, 1 - post)]
        wrong = []
        for k, p in ((1, post), (0, 1 - post)):
            said = rows * p * (labels >= 0)
            wrong.append(((said * (labels != k)).sum() + LABEL_ERROR * BELIEF) / (said.sum() + BELIEF))
        weight = shared_weight(votes, rows, post, rate)
        fires = np.log(rate[0] / rate[1]) * weight
        rests = np.log((1 - rate[0]) / (1 - rate[1])) * weight
        said = np.where(labels == 1, np.log((1 - wrong[0]) / wrong[1]), np.log(wrong[0] / (1 - wrong[1])))
        odds = np.log(share / (1 - share)) + votes @ (fires - rests) + rests.sum() + said * (labels >= 0)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def fit_logistic(votes: np.ndarray, post: np.ndarray, rows: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of the voters and, last, the bias, by Newton steps on the posterior labels.

    ``rows`` tells how often each row stands for.
    """
    x = np.hstack([votes, np.ones((len(votes), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (rows * (p - post)) + penalty * w
        bend = (x * (rows * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(bend, slope)
    return w


@dataclass(frozen=True)
class ToxicityModel:
    """The voters' weights in the linear classifier, and its bias."""

    names: list[str]
    weights: list[float]
    bias: float


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from the sampled documents (see ``training_rows``).

    The driver gets a row for each distinct set of votes and label.  Where no voter ever fires, or the
    sample is empty, the lexicon's words have a fixed weight.
    """
    rows = saved(training_rows(docs, labels), "sample")
    stems = stem_voters(rows)
    names = list(dict.fromkeys([*LEXICON, *PATTERNS, *COUNTS, *stems]))

    def make():
        voters = Voters(names)
        return lambda texts, toxic: ([voters.fired(t) for t in texts], toxic)

    fired = map_columns(rows, make, "fired array<int>, toxic int")
    found = fired.groupBy("fired", "toxic").agg(F.count("*").alias("n")).collect()
    votes = np.zeros((len(found), len(names)), np.float32)
    for row, r in enumerate(found):
        votes[row, r["fired"]] = 1
    if not votes.any():
        return ToxicityModel(names, [6.0 * (n in LEXICON) for n in names], -3.0)
    seen, times = votes.any(axis=0), np.array([r["n"] for r in found], np.float64)
    given = np.array([-1 if r["toxic"] is None else r["toxic"] for r in found])
    own = votes[:, seen]
    post = label_posterior(own, given, times)
    # texts without a label inform the label model; they train the classifier only where there are no
    # labels, since their posteriors make it worse than those that a label voted on
    both = (given == 1).any() and (given == 0).any()
    taken = given >= 0 if both else np.full(len(given), True)
    # a voter that never fired in the sample says nothing
    weights = np.zeros(len(names))
    fitted = fit_logistic(own[taken], post[taken], times[taken])
    weights[seen], bias = fitted[:-1], float(fitted[-1])
    return ToxicityModel(names, weights.tolist(), bias)


def _scorer(model: ToxicityModel):
    def make():
        voters, weights = Voters(model.names), np.array(model.weights)

        def one(text: str) -> float:
            odds = model.bias + weights[voters.fired(text)].sum()
            return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

        return lambda ids, texts: (ids, [one(t) for t in texts])

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``.

    ``labels`` are ``doc_id`` and ``toxic`` (0 or 1, others and nulls ignored; of repeated ids the
    larger).  ``held_out`` tells that the row's label is never learned from; false without a
    doc_id.  ``score`` rises with the likelihood of label 1 and depends on the text alone, which is read
    whole, however long it is; a null or empty text has the score of a text without any voter.  ``predicted`` is 1 from ``threshold``
    on.  Repeated rows come out as often as they come in; an empty table gives an empty table; other
    columns are ignored.
    """
    model = fit_toxicity(docs, labels)
    return map_columns(documents(docs), _scorer(model), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more.

    A null text counts as empty.  Repeated rows go or stay together, rows without a doc_id are treated
    like any other, all columns pass through, and an empty table gives an empty table.
    """
    model = fit_toxicity(docs, labels)
    make = _scorer(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = make()
        for texts in batches:
            yield pd.Series(one(None, texts)[1], dtype="float64")

    return small_batches(docs).filter(score(F.coalesce("text", F.lit(""))) < threshold)
