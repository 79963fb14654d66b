"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all sampled texts, their labels hidden,
are the unlabelled ones. With the share of toxic texts (class prior) known, the
risk on clean texts is the unlabelled risk minus the prior's part of the
positive one, held at zero or above. Linear classifiers over the presence of
words and word beginnings are trained in numpy on a bounded sample; every text
is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Batches, columns, lean, packed, slices
from strataloom.session import cut_lineage

SAMPLE = 12_000  # labelled rows to learn from, in expectation
FEATURES = 4_096  # words and beginnings a classifier may look at
LEAST_TEXTS = 5  # texts of the sample that a feature must occur in
STRENGTH = 4.0  # standard deviations by which its share of toxic texts must differ from all texts'
BEGINNINGS = (4, 5, 6, 7)  # letters of the word beginnings that are features too
CACHED = 400_000  # words whose features a worker keeps
MEMBERS = 3  # classifiers, each trained without one part of the sample

_words = re.compile(r"[^\W\d_]+").findall
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def words(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def marks(word: str) -> list[str]:
    """A word and its beginnings, which tell the forms of one stem together."""
    return [word, *(word[:k] + "~" for k in BEGINNINGS if k <= len(word))]


def fold(doc_id: Column, folds: int = 5) -> Column:
    """``crc32`` of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def risk_gradient(score_p: np.ndarray, score_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the non-negative risk by the scores, for the sigmoid loss ``1 / (1 + exp(s))``.

    Where the estimated risk on clean texts is below zero, its gradient is
    turned round, so that training steps back from fitting the sample.
    """
    toxic_p, toxic_u = 1 / (1 + np.exp(-score_p)), 1 / (1 + np.exp(-score_u))
    slope_p, slope_u = toxic_p * (1 - toxic_p) / len(score_p), toxic_u * (1 - toxic_u) / len(score_u)
    clean_risk = toxic_u.mean() - prior * toxic_p.mean()
    if clean_risk < 0:
        return prior * slope_p, -slope_u
    return -2 * prior * slope_p, slope_u


def fit(rows: list[np.ndarray], toxic: np.ndarray, n_features: int, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the intercept of one classifier; ``rows`` are the features present in each text."""
    sizes = np.array([len(r) for r in rows])
    of_row = np.repeat(np.arange(len(rows)), sizes)
    at = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    weights, mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    weights[-1] = -1.0
    for step in range(1, steps + 1):
        scores = np.bincount(of_row, weights[at], len(rows)) + weights[-1]
        slope = np.zeros(len(rows))
        of_p, of_u = risk_gradient(scores[toxic], scores, prior)
        slope[toxic] += of_p
        slope += of_u
        gradient = np.append(np.bincount(at, slope[of_row], n_features), slope.sum()) + decay * weights
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def _word_batches(batches: Batches) -> Batches:
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.bool_()), ("words", pa.list_(pa.string()))])
    rows = ((k, y, sorted({m for w in words(t) for m in marks(w)})) for part in slices(batches) for k, y, t in zip(*columns(part, "key", "toxic", "text"), strict=True))
    yield from packed(rows, schema, lambda row: 16 + 16 * len(row[2]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[dict[str, float], float]:
    """Word weights and intercept from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, folds other than 0 only.

    Of the labelled rows about ``sample`` take part, chosen by a hash of the id;
    equal texts count once. Labels that are null and ids without a text are
    left out. Without any toxic or any other text nothing is learned and every
    score is 0.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    share = sample / max(1, marked.count())
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about ``sample`` rows of an id and a flag: small enough to be sent to every task
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy(F.xxhash64("text").alias("key"), "toxic").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(_word_batches, "key long, toxic boolean, words array<string>")
    found = cut_lineage(found)
    totals = found.groupBy("toxic").count().collect()
    n_toxic, n = sum(r["count"] for r in totals if r["toxic"]), sum(r["count"] for r in totals)
    if not n_toxic or n_toxic == n:
        return {}, -np.inf
    counted = found.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("p"))
    expected = F.col("n") * (n_toxic / n)
    top = (
        counted.where(F.col("n") >= LEAST_TEXTS)
        .select("word", (F.abs(F.col("p") - expected) / F.sqrt(expected)).alias("strength")).where(F.col("strength") >= STRENGTH).orderBy(F.desc("strength"), "word").limit(features)
    )
    place = {r["word"]: k for k, r in enumerate(top.collect())}
    chosen = list(place)
    rows, toxic, key = [], [], []
    kept = found.select("key", "toxic", F.array_intersect("words", F.array(*map(F.lit, chosen)) if chosen else F.expr("array('')")).alias("words"))
    for r in kept.toLocalIterator():
        rows.append(np.array([place[w] for w in r["words"]], np.int64))
        toxic.append(r["toxic"])
        key.append(r["key"])
    toxic, part = np.array(toxic), np.array(key) % MEMBERS
    order = np.argsort(key, kind="stable")
    total, members = np.zeros(len(chosen) + 1), 0
    for left_out in range(MEMBERS):
        own = [i for i in order if part[i] != left_out]
        if 0 < toxic[own].sum() < len(own):
            total += fit([rows[i] for i in own], toxic[own], len(chosen), n_toxic / n)
            members += 1
    weights = total / max(1, members)
    return {w: float(v) for w, v in zip(chosen, weights, strict=False) if abs(v) > 1e-3}, float(weights[-1]) if members else -np.inf


def _scorer(weights: dict[str, float], intercept: float) -> Callable[[str | None], float]:
    known: dict[str, tuple[str, ...]] = {}

    def score_of(text: str | None) -> float:
        if len(known) > CACHED:
            known.clear()
        present: set[str] = set()
        for word in words(text):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(m for m in marks(word) if m in weights)
            if own:
                present.update(own)
        z = intercept + sum(sorted(map(weights.__getitem__, present)))
        if z == -np.inf:  # nothing was learned
            return 0.0
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, z)))))

    return score_of


def score(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a null or empty text has the score of no word."""

    def run(batches: Batches) -> Batches:
        score_of = _scorer(weights, intercept)

        def rows():
            for part in slices(batches):
                for doc, held, text in zip(*columns(part, "doc_id", "held_out", "text"), strict=True):
                    value = score_of(text)
                    yield doc, held, value, int(value >= 0.5)

        yield from packed(rows(), SCORED)

    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic; row by row, without a shuffle.

    A null text is scored as an empty one, equal texts alike; null ids and repeated
    rows are judged by their text. Without labels no text is rejected more than an
    empty one; an empty table stays empty.
    """
    weights, intercept = learn(docs, labels, sample)

    def run(batches: Batches) -> Batches:
        score_of = _scorer(weights, intercept)
        for part in slices(batches):
            yield part.filter(pa.array([score_of(t) < 0.5 for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from ``labels`` and score all ``docs``; extra columns are not looked at, repeated rows are scored alike."""
    return score(docs, *learn(docs, labels, sample))
