"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade > k) = logistic(w.x - threshold_k) for k = 0..K-1: one weight vector for all thresholds, which ascend.
The expected severity is the sum of these probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.work import small_batches

WORD = re.compile(r"[^\W_]+")
FEATURE_BITS = 22
REMEMBERED = 200_000


def _feature(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> (64 - FEATURE_BITS)


def words_of(text: str | None) -> set[str]:
    """Distinct words: runs of letters and digits, in lower case."""
    return set(WORD.findall(text.lower())) if text else set()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({_feature(w) for w in words_of(t)}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["id", "toxic", "features"])


@dataclass(frozen=True)
class Model:
    """Weights by feature, ascending thresholds, and the expected severity from which a text counts as toxic."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]
    cutoff: float

    def severity(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade of each linear score."""
        return (1 / (1 + np.exp(-(np.asarray(scores)[:, None] - np.array(self.thresholds))))).sum(axis=1)


def _select(docs: list[np.ndarray], toxic: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features whose share of toxic texts differs most from that of the others, by z; and those z."""
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    who = np.repeat(toxic, [len(d) for d in docs])
    names, where = np.unique(flat, return_inverse=True)
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    in1, in0 = np.bincount(where, who, len(names)), np.bincount(where, ~who, len(names))
    p = (in1 + in0) / (n1 + n0)
    z = (in1 / n1 - in0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    z[(in1 + in0 < 3) | (p >= 1)] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    best = best[np.abs(z[best]) >= 3]
    return names[best], z[best]


def loss_and_slope(w: np.ndarray, t: np.ndarray, rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood plus penalty / 2 * |w|^2, and its slopes by w and by t.

    Text rows[i] has feature cols[i]. Thresholds are t[0], t[0] + exp(t[1]), ..., so they ascend whatever t is.
    """
    n, width, top = len(grades), len(w), len(t)
    theta = thresholds_of(t)
    score = np.bincount(rows, w[cols], n)
    above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))  # P(grade > k)
    edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    p = np.maximum(edge[np.arange(n), grades] - edge[np.arange(n), grades + 1], 1e-9)
    slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
    low, high = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
    by_score = -(low - high) / n
    by_theta = np.array([(np.where(grades == k + 1, low, 0) - np.where(grades == k, high, 0)).sum() for k in range(top)]) / n
    tail = by_theta[::-1].cumsum()[::-1]
    loss = -np.log(p).mean() + penalty / 2 * (w**2).sum()
    return float(loss), np.bincount(cols, by_score[rows], width) + penalty * w, np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])


def thresholds_of(t: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def _fit(rows: np.ndarray, cols: np.ndarray, width: int, grades: np.ndarray, top: int, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam."""
    w, t = np.zeros(width), np.concatenate([[1.0], np.zeros(top - 1)])
    m = v = np.zeros(width + top)
    for step in range(1, steps + 1):
        _, by_w, by_t = loss_and_slope(w, t, rows, cols, grades, penalty)
        g = np.concatenate([by_w, by_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:width], t - move[width:]
    return w, thresholds_of(t)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> DataFrame:
    """(id, toxic, text) of at most train_rows labelled ids, those with the smallest hash; one text for each.

    An id with several labels is toxic if any of them says so; of several texts, the one with the smallest hash
    counts. So the rows depend on the tables' contents alone, not on their order or partitioning.
    """
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    chosen = ids.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # train_rows rows at most
    return joined.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 12_000, grades: int = 3, max_features: int = 4096, penalty: float = 1e-3, steps: int = 400) -> Model:
    """Fits on at most train_rows labelled rows (see labelled()); equal tables give equal models.

    Labels are 0 or 1; toxic texts are graded 1..grades by quantiles of the number of distinct words in them that
    are far more frequent in toxic texts. A quarter of the rows, chosen by a hash of the id, is held out of all that
    (choice of words included) and sets the cutoff (best F1 with precision counting double); then all rows are fitted.
    Unless there are toxic and other rows besides the held-out ones, nothing is toxic. Null labels or ids take no part;
    a null text has no words; empty tables and other columns do no harm.
    """
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col, label_col, train_rows).mapInArrow(_features, "id long, toxic int, features array<int>").toArrow().sort_by("id")
    toxic = np.array(rows.column("toxic").to_pylist(), np.int64) > 0
    found = [np.array(x, np.int64) for x in rows.column("features").to_pylist()]
    held = np.array([xxhash.xxh3_64_intdigest(f"held:{i}".encode()) % 4 == 0 for i in rows.column("id").to_pylist()], bool)
    if not toxic[~held].any() or toxic[~held].all():
        return Model({}, tuple(10.0 + k for k in range(grades)), float(grades))
    fitted = lambda use: _model([found[i] for i in np.flatnonzero(use)], toxic[use], grades, max_features, penalty, steps)
    judge = fitted(~held)
    scores = np.array([sum(judge.weights.get(f, 0.0) for f in found[i].tolist()) for i in np.flatnonzero(held)])
    return replace(fitted(np.ones(len(found), bool)), cutoff=_cutoff(judge.severity(scores), toxic[held]))


def _model(found: list[np.ndarray], toxic: np.ndarray, grades: int, max_features: int, penalty: float, steps: int) -> Model:
    """Words, grades and weights from these texts alone; the cutoff is left open."""
    names, z = _select(found, toxic, max_features)
    lexicon = set(names[z >= 6].tolist())
    hits = np.array([sum(f in lexicon for f in d.tolist()) for d in found])
    cuts = np.quantile(hits[toxic], np.arange(1, grades) / grades)
    y = np.where(toxic, 1 + (hits[:, None] > cuts).sum(axis=1), 0)
    ranked = np.sort(names)
    kept = [np.flatnonzero(np.isin(ranked, d, assume_unique=True)) for d in found]
    r = np.repeat(np.arange(len(found)), [len(k) for k in kept])
    w, theta = _fit(r, np.concatenate(kept).astype(np.int64), len(ranked), y, grades, penalty, steps)
    return Model(dict(zip(ranked.tolist(), w.tolist())), tuple(theta.tolist()), 0.5)


def _cutoff(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The expected severity with the best F0.5 on held-out texts; 0.5 if none of them is toxic."""
    best, cutoff = 0.0, 0.5
    for t in np.linspace(0.2, 1.2, 41):
        said = severity >= t
        right = (said & toxic).sum()
        precision, recall = right / max(1, said.sum()), right / max(1, toxic.sum())
        f = 1.25 * precision * recall / max(1e-9, 0.25 * precision + recall)
        if f > best + 1e-9:
            best, cutoff = f, float(t)
    return cutoff


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                total, seen = 0.0, set()
                for word in words_of(text):
                    weight = known.get(word)
                    if weight is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        weight = known[word] = model.weights.get(_feature(word), 0.0)
                    if weight:
                        feature = _feature(word)
                        if feature not in seen:
                            seen.add(feature)
                            total += weight
                scores.append(total)
            severity = model.severity(np.array(scores)) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(severity, 9))], names=["doc_id", "severity"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, severity (expected grade), grade (rounded) and toxic (severity at least the cutoff) for every row.

    A null or empty text has no features and gets the grade of the thresholds alone. Whole texts are read, whatever
    their length. Ids may be null; repeated rows are scored one by one; an empty table gives no rows; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = chosen.mapInArrow(_scorer(model), "doc_id long, severity double")
    return scored.withColumns({"grade": F.rint("severity").cast("int"), "toxic": F.col("severity") >= model.cutoff})


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns; nothing is shuffled.

    A null or empty text has no features: it stays unless the thresholds alone reach the cutoff. Ids aren't looked at;
    repeated rows go or stay together; an empty table gives an empty one; columns may have any names.
    """
    small_batches(docs.sparkSession)
    schema = docs.schema
    at = schema.names.index(text_col)
    judge = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            slim = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            for said in judge(iter([slim])):
                yield batch.filter(pa.array(said.column(1).to_numpy() < model.cutoff))

    return docs.mapInArrow(run, schema)
