"""Operator 6: toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0 < 1 < ... < K-1 share one weight vector; ordered thresholds t_1 < ... < t_{K-1} give
P(grade >= j) = sigmoid(w.x - t_j), and the expected severity is the sum of these. Features are the distinct
words of a text and their beginnings (lower case, letters and digits), hashed to 32 bits; the words of the model that a text holds
share a weight of one (1/n each), so severity does not grow with length alone.

The model is fitted in numpy on the driver from at most `max_labelled` labelled documents (a documented bound;
those with the least hash of their id, the same ones each time). Only their feature columns are collected. Words
enter the model if their link to the grade passes a likelihood-ratio test at `level` over all words seen, at most
`max_words` of them, those with the highest ratio. All documents are scored by tasks that get these weights.

Null and empty texts have no features and get the severity of the thresholds alone. Labels that are null are
left out; with no labelled rows, or one grade only, each severity is the mean grade (0 with none at all). A document
labelled several times counts with each label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain
from math import fsum
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Memo, id_text, sliced

_WORDS = re.compile(r"\w+").findall


class OrdinalModel(NamedTuple):
    weights: dict[int, float]  # by feature column
    thresholds: np.ndarray  # K - 1, ascending
    constant: float | None = None  # severity where nothing could be fitted


def columns_of(word: str) -> tuple[int, ...]:
    """The columns of a word and of its beginnings of 4 to 7 letters, which inflected and compound forms share."""
    forms = [word, *(word[:n] + "*" for n in range(4, 8) if len(word) >= n)]
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in forms)


def features(text: str) -> list[int]:
    return sorted({c for w in set(_WORDS(text.lower())) for c in columns_of(w)})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _row_weights(columns: np.ndarray, owner: np.ndarray, n: int, names: np.ndarray, rounds: int = 8, rare: float = 0.02) -> np.ndarray:
    """1 / the number of labelled rows that are near copies of each other, so that a copied text counts once.

    Near copies share the least of their rarer words under some of several orders; rows with the same two least
    words in one order are joined.
    """
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    keep = (np.bincount(columns, minlength=len(names)) <= max(3, rare * n))[columns]
    owner, values = owner[keep], names[columns[keep]].astype(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    rows = owner[starts]
    spans = np.diff(np.append(starts, len(owner)))
    top = np.uint64(2**64 - 1)
    for r in range(rounds if len(owner) else 0):
        h = (values + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15 + 2 * r)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum.reduceat(h, starts)
        second = np.minimum.reduceat(np.where(h == np.repeat(least, spans), top, h), starts)
        first: dict[tuple, int] = {}
        for i, pair in zip(rows.tolist(), zip(least.tolist(), second.tolist(), strict=True), strict=True):
            parent[root(i)] = root(first.setdefault(pair, i))
    roots = np.array([root(i) for i in range(n)])
    return 1 / np.bincount(roots, minlength=n)[roots]


def _ratio(with_high: np.ndarray, with_low: np.ndarray, high: float, low: float) -> np.ndarray:
    """Likelihood ratio (G) of a word's presence and a grade above 0, for each word."""
    seen, n = with_high + with_low, high + low
    g = np.zeros(len(seen))
    for observed, expected in ((with_high, seen * high / n), (with_low, seen * low / n), (high - with_high, (n - seen) * high / n), (low - with_low, (n - seen) * low / n)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(observed > 0, observed * np.log(observed / expected), 0.0)
    return 2 * g


def fit(rows: list[tuple[Sequence[int], int]], grades: int, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4, level: float = 0.01, max_words: int = 20_000) -> OrdinalModel:
    """Maximum likelihood with a ridge by Adam, over the words that pass the test."""
    y = np.array([g for _, g in rows], np.int64)
    if len(y) == 0 or y.min() == y.max():
        return OrdinalModel({}, np.zeros(max(1, grades - 1)), float(y.mean()) if len(y) else 0.0)
    names, columns = np.unique(np.concatenate([np.asarray(c, np.uint32) for c, _ in rows]), return_inverse=True)
    columns, owner = columns.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c, _ in rows])
    high = y > 0
    rows_weight = _row_weights(columns, owner, len(rows), names)
    ratio = _ratio(np.bincount(columns, (high * rows_weight)[owner], len(names)), np.bincount(columns, (~high * rows_weight)[owner], len(names)), rows_weight[high].sum(), rows_weight[~high].sum())
    best = np.argsort(-ratio, kind="stable")[:max_words]
    used = np.sort(best[ratio[best] > 2 * np.log(max(len(names), 2) / level)])
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    keep = place[columns] >= 0
    columns, owner = place[columns[keep]], owner[keep]
    value = 1 / np.bincount(owner, minlength=len(rows))[owner]
    rows_weight = rows_weight / rows_weight.sum()
    n, k = len(rows), grades - 1
    share = np.array([np.clip(np.sum((y >= j) * rows_weight), 1e-4, 1 - 1e-4) for j in range(1, grades)])
    start = np.log((1 - share) / share)
    # theta: the weights, the first threshold, logs of the gaps between thresholds
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    w = slice(0, len(used))
    for step in range(1, steps + 1):
        gaps = np.exp(theta[len(used) + 1 :])
        t = theta[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, theta[w][columns] * value, n)
        upper = _sigmoid(score[:, None] - t[None, :])  # P(y >= j), j = 1..K-1
        p = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], axis=1)
        prob = np.maximum(p[np.arange(n), y] - p[np.arange(n), y + 1], 1e-9)
        slope = p * (1 - p)
        d_score = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / prob * rows_weight
        d_t = np.zeros((n, k + 2))
        d_t[np.arange(n), y] += slope[np.arange(n), y] / prob * rows_weight
        d_t[np.arange(n), y + 1] -= slope[np.arange(n), y + 1] / prob * rows_weight
        d_t = d_t[:, 1 : k + 1].sum(axis=0)
        tail = np.cumsum(d_t[::-1])[::-1]
        grad = np.concatenate([np.bincount(columns, d_score[owner] * value, len(used)) + ridge * theta[w], [tail[0]], tail[1:] * gaps])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))])
    return OrdinalModel(dict(zip(names[used].tolist(), theta[w].tolist(), strict=True)), t)


def fitted(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", max_labelled: int = 4000, **options) -> OrdinalModel:
    """Fit on at most max_labelled labelled rows. `grade` is an expression over labels, 0..grades-1."""
    marked = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    chosen = marked.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "grade").limit(max_labelled).select("doc_id", "grade")  # bounded: broadcast below
    joined = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = pa.array([np.array(features(t.as_py()), np.uint32).tobytes() for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], columns], names=["doc_id", "grade", "columns"])

    held = joined.mapInArrow(run, "doc_id long, grade int, columns binary").toArrow()
    rows = sorted(zip(*[held[c].to_pylist() for c in ("doc_id", "grade", "columns")], strict=True))  # the same order each time
    return fit([(np.frombuffer(c, np.uint32), min(max(g, 0), grades - 1)) for _, g, c in rows], grades, **options)


def _scorer(m: OrdinalModel, memo: int):
    """Scores of a text under the model, for use within one task."""
    columns = Memo(lambda w: tuple(c for c in columns_of(w) if c in m.weights), memo).__getitem__

    def scored(text: str) -> float:
        found = set(chain.from_iterable(map(columns, set(_WORDS(text.lower())))))
        return fsum(map(m.weights.__getitem__, found)) / max(1, len(found))

    return scored


def _judged(m: OrdinalModel, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity and P(grade >= 1)."""
    if m.constant is not None:
        return np.full(len(score), m.constant), np.full(len(score), min(1.0, m.constant))
    p = _sigmoid(score[:, None] - m.thresholds[None, :])
    return p.sum(axis=1), p[:, 0]


def severities(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", memo: int = 150_000) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (P(grade >= 1)), a row for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(sent.value, memo)
        for batch in sliced(batches):
            severity, toxic = _judged(sent.value, np.array([scored(t.as_py()) for t in batch["text"]], np.float64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(severity), pa.array(toxic)], names=["doc_id", "severity", "p_toxic"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, p_toxic double")


def without_toxic(docs: DataFrame, model: OrdinalModel, threshold: float, text_col: str = "text", memo: int = 150_000) -> DataFrame:
    """docs less those with P(grade >= 1) at the threshold or above; all columns stay, nothing is shuffled."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(sent.value, memo)
        for batch in sliced(batches):
            _, toxic = _judged(sent.value, np.array([scored(t.as_py() or "") for t in batch.column(at)], np.float64))
            yield batch.filter(pa.array(toxic < threshold))

    return docs.mapInArrow(run, docs.schema)
