"""Toxicity grades by cumulative-link ordinal regression.

Features are words and word beginnings (three to five letters), lower-cased, valued 1 + log(count). The model has one
weight per feature, shared by ordered thresholds: P(grade <= k) = sigmoid(threshold_k - x.w). The expected severity is
the sum over k of P(grade > k); a document is rejected when P(grade > 0) reaches one half.

The label table only says toxic or not, so grades above zero are told apart by how many words a labelled document has
with toxic features of CLEAR_GAIN or more (GRADE_EDGES). Fitting uses at most SAMPLE_ROWS labelled documents of each
class, the first by a hash of the id, weighted back to the class totals. The FEATURES keys that tell the classes apart
best get a weight, however few documents there are, if more than one has them; the ridge term shrinks them. All else is
distributed: the sample is found by a broadcast of at most 2 * SAMPLE_ROWS ids, feature counts are summed by Spark, and
scoring reads every document whole.

Defined cases: a null text reads as empty and scores its thresholds alone; labels that are null, or whose document is
missing, are left out; a document labelled more than once is toxic if any label says so; without both classes nothing
is rejected; of several documents with one id the smallest text is fitted; repeated rows get one result each; an empty
table gives an empty result. The driver gets at most 2 * SAMPLE_ROWS rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import Columns, map_slices, slices, texts

SAMPLE_ROWS = 3000
FEATURES = 2000
LEAST_DOCUMENTS = 2
CLEAR_GAIN = 30.0
GRADE_EDGES = (3, 6)
REJECT_AT = 0.5
WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5)


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (40.0, 41.0, 42.0)

    def probabilities(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [1.0 / (1.0 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


class Scorer:
    """Scores of texts; remembers which words carry features."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit, self.known = model, limit, {}

    def hits(self, word: str) -> tuple[str, ...]:
        if len(self.known) >= self.limit:
            self.known.clear()
        found = self.known[word] = tuple(f for f in features_of(word) if f in self.model.weights)
        return found

    def score(self, text: str) -> float:
        known, counts = self.known, Counter()
        for word in WORDS.findall(text.lower()):
            found = known.get(word)
            if found is None:
                found = self.hits(word)
            if found:
                counts.update(found)
        weights = self.model.weights
        return sum(weights[f] * (1.0 + math.log(counts[f])) for f in sorted(counts))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of at most `rows` labelled documents a class, and what one row of each class stands for."""
    clean = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r.toxic: r.n for r in clean.where("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for value in (0, 1):
        part = clean.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * rows narrow rows, so the broadcast is bounded; and one row for each of them, however often an id occurs.
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return found, {k: n / min(n, rows) for k, n in totals.items()}


def select_features(sample: DataFrame, size: int = FEATURES) -> dict[str, bool]:
    """The features that tell the classes apart best (G statistic), with whether they speak clearly for toxic."""

    def start():
        def work(rows: Columns) -> Columns:
            seen: Counter = Counter()
            for text, toxic in zip(rows["text"], rows["toxic"]):
                found = {f for w in set(WORDS.findall(text.lower())) for f in features_of(w)}
                seen.update((f, toxic) for f in found)
            keys = sorted({f for f, _ in seen})
            return {"feature": keys, "toxic": [seen[(k, 1)] for k in keys], "clean": [seen[(k, 0)] for k in keys]}

        return work

    counts = map_slices(sample.select("text", "toxic"), start, "feature string,toxic long,clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    rate = F.lit(n[1] / (n[0] + n[1]))
    total = F.col("a") + F.col("b")

    def part(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    gain = part(F.col("a"), total * rate) + part(F.col("b"), total * (1 - rate))
    best = counts.where(total >= LEAST_DOCUMENTS).withColumn("gain", F.round(gain, 6)).where("gain > 0").orderBy(F.col("gain").desc(), "feature").limit(size).collect()
    return {r.feature: r.gain > CLEAR_GAIN and r.a / n[1] > r.b / n[0] for r in best}


def grade_of(toxic: int, hits: int) -> int:
    return 0 if not toxic else 1 + sum(hits >= edge for edge in GRADE_EDGES)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, importance: np.ndarray, n_features: int, ridge: float = 5e-5, steps: int = 400):
    """Weights and ordered thresholds by full-batch gradient steps (Adam) on the mean log loss; starts from zero."""
    n, levels = len(grades), len(GRADE_EDGES) + 1
    share = importance / importance.sum()
    w, first, gaps = np.zeros(n_features), 1.0, np.zeros(levels - 1)
    state = [np.zeros(n_features + levels), np.zeros(n_features + levels)]
    for step in range(1, steps + 1):
        score = np.bincount(rows, values * w[cols], n)
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        below = 1.0 / (1.0 + np.exp(np.clip(score[:, None] - thresholds, -60, 60)))
        upper = np.concatenate([below, np.ones((n, 1))], 1)[np.arange(n), grades]
        lower = np.concatenate([np.zeros((n, 1)), below], 1)[np.arange(n), grades]
        mass = np.maximum(upper - lower, 1e-12)
        slope_up = np.where(grades < levels, upper * (1 - upper), 0.0) / mass * share
        slope_low = np.where(grades > 0, lower * (1 - lower), 0.0) / mass * share
        d_threshold = -np.bincount(np.minimum(grades, levels - 1), slope_up, levels) + np.bincount(np.maximum(grades - 1, 0), slope_low, levels)
        d_score = slope_up - slope_low
        d_w = np.bincount(cols, values * d_score[rows], n_features) + ridge * w
        tail = np.cumsum(d_threshold[::-1])[::-1]
        gradient = np.concatenate([d_w, [d_threshold.sum()], tail[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w, first, gaps = w - move[:n_features], first - move[n_features], gaps - move[n_features + 1:]
    thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return w, tuple(float(t) for t in thresholds)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = FEATURES) -> Model:
    """Fit the model; the driver gets `size` features and the sparse counts of at most 2 * `rows` documents."""
    sample, stands_for = labelled_sample(texts(docs), labels, rows)
    sample = sample.persist()
    try:
        chosen = select_features(sample, size)
        if not chosen:
            return Model()
        index = {f: i for i, f in enumerate(sorted(chosen))}

        def start():
            scorer = Scorer(Model(weights=dict.fromkeys(index, 1.0)))

            def work(part: Columns) -> Columns:
                out: Columns = {"doc_id": part["doc_id"], "toxic": part["toxic"], "cols": [], "counts": [], "hits": []}
                for text in part["text"]:
                    counts, hits = Counter(), 0
                    for word in WORDS.findall(text.lower()):
                        found = scorer.known.get(word)
                        if found is None:
                            found = scorer.hits(word)
                        counts.update(found)
                        hits += any(chosen[f] for f in found)
                    cols = sorted(index[f] for f in counts)
                    names = {index[f]: counts[f] for f in counts}
                    out["cols"].append(cols)
                    out["counts"].append([names[c] for c in cols])
                    out["hits"].append(hits)
                return out

            return work

        got = map_slices(sample, start, "doc_id long,toxic int,cols array<int>,counts array<int>,hits long").collect()
    finally:
        sample.unpersist()
    got.sort(key=lambda r: (r.doc_id, r.hits, r.toxic))
    lengths = np.array([len(r.cols) for r in got])
    rows_at = np.repeat(np.arange(len(got)), lengths)
    cols = np.array([c for r in got for c in r.cols], dtype=np.int64)
    values = 1.0 + np.log(np.array([c for r in got for c in r.counts], dtype=float))
    grades = np.array([grade_of(r.toxic, r.hits) for r in got])
    importance = np.array([stands_for[r.toxic] for r in got])
    w, thresholds = fit_ordinal(rows_at, cols, values, grades, importance, len(index))
    return Model({f: float(w[i]) for f, i in index.items()}, thresholds)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: expected severity, P(grade > 0), the most likely grade, and whether it is rejected."""

    def start():
        scorer = Scorer(model)

        def work(rows: Columns) -> Columns:
            out: Columns = {"doc_id": rows["doc_id"], "severity": [], "p_toxic": [], "grade": [], "toxic": []}
            for text in rows["text"]:
                above = model.probabilities(scorer.score(text))
                mass = [1.0 - above[0], *(a - b for a, b in zip(above, [*above[1:], 0.0]))]
                out["severity"].append(sum(above))
                out["p_toxic"].append(above[0])
                out["grade"].append(mass.index(max(mass)))
                out["toxic"].append(above[0] >= REJECT_AT)
            return out

        return work

    return map_slices(texts(docs), start, "doc_id long,severity double,p_toxic double,grade long,toxic boolean")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""

    def run(batches):
        scorer = Scorer(model)
        for part in slices(batches, text_col, 2 << 20):
            listed = part.column(part.schema.get_field_index(text_col)).to_pylist()
            keep = [model.probabilities(scorer.score(t or ""))[0] < REJECT_AT for t in listed]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
