"""The stages of the corpus pipeline, one after the other, against plain code over the same rows."""

import re
from collections import Counter

import pytest
from test_pairs import components, jaccard
from test_texts import check_mix, plain_lines
from test_toxicity import plain_scores

import corpus_pipeline
from vellum.llm.decontaminate import RADIUS, shingles, simhash, weighted_jaccard, words_of
from vellum.llm.toxicity import fit_toxicity


def folded_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[ \t\n\r\x0b\x0c]+", lower) if w]


def plain_near(rows):
    """The rows whose doc_id is the smallest of its near copies."""
    words = [folded_words(t) for _, t in rows]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            same = not sets[i] and not sets[j]
            if same or (sets[i] & sets[j] and jaccard(words[i], words[j]) >= 0.8):
                links.append((j, i))
    roots = components(len(rows), links)
    return [r for k, r in enumerate(rows) if r[0] == min(rows[x][0] for x in range(len(rows)) if roots[x] == roots[k])]


def holds(text, item):
    """Whether a window of the text is the item's: five words, weighted similarity of 0.8."""
    words, own = words_of(text or ""), words_of(item or "")
    if not words or not own:
        return False
    size, want = min(len(own), len(words)), Counter(shingles(own))
    common = [k for k, s in enumerate(shingles(words)) if s in want]
    near = {k for c in common for k in range(max(0, c - size), min(len(words) - size, c) + 1)}
    code = simhash(shingles(own))
    for start in near:
        part = shingles(words[start : start + size])
        if weighted_jaccard(Counter(part), want) >= 0.8 and (simhash(part) ^ code).bit_count() <= RADIUS:
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, rows before, rows after) of each stage but the last, and the rows of the last."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
        sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
        done = stage(spark, docs, sf_dir)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs, sources)
    return out


def after(stages, name):
    return [(r["doc_id"], r["text"]) for r in stages[name][1].orderBy("doc_id").collect()]


def test_toxicity_stage(spark, sf_dir, stages):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = plain_scores(fit_toxicity(docs, labels))
    assert after(stages, "toxicity") == [(i, t) for i, t in stages["toxicity"][0] if scores(t or "") < 0.7]


def test_line_dedup_stage(stages):
    assert after(stages, "line_dedup") == sorted((i, t) for i, t, *_ in plain_lines(stages["line_dedup"][0]))


def test_near_dedup_stage(stages):
    assert after(stages, "near_dedup") == plain_near(stages["near_dedup"][0])


def test_decontamination_stage(spark, sf_dir, stages):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [(i, t) for i, t in stages["decontamination"][0] if not any(holds(t, item) for item in items)]
    assert len(want) < len(stages["decontamination"][0])
    assert after(stages, "decontamination") == want


def test_mixing_stage(stages):
    before, done, sources = stages["mixing"]
    check_mix([(i, t, sources[i]) for i, t in before], done.collect())
