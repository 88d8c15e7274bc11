"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(x.w - threshold_k): one weight vector for all grades and ordered thresholds. The
features are shares of a text's words by hash and by hashed shape (letters, capitals, digits and marks
with runs folded), and the share of words that repeat the one before, so that habits of writing count as
well as words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import gathered, held_out, narrow, sample_of_each
from shelfspark.llm.words import _BYTE, Words, chunks, mix, places

WORD_BITS, SHAPE_BITS = 14, 10
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 4
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    grades: list[int] = field(default_factory=list)


def _shapes(w: Words) -> np.ndarray:
    c = _CLASS[w.buf]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    new[w.start] = True
    rank = np.cumsum(new)
    begin = np.zeros(len(c), np.int64)
    begin[w.start] = rank[w.start]
    place = np.maximum(rank - np.maximum.accumulate(begin), 0)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(new, _BYTE[c] * places(place), np.uint64(0)))])
    return mix(sums[w.end] - sums[w.start])


def _cells(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts with (text, feature, value) of what is not 0."""
    for lo, hi, buf, offsets in chunks(texts):
        w = Words(buf, offsets)
        n = np.maximum(np.diff(w.first), 1)
        part = 1.0 / n[w.doc]
        h = w.hashes()
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        again = np.bincount(w.doc, again * part, hi - lo)
        word = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        shape = (_shapes(w) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
        size = np.minimum(np.log1p(np.diff(w.first)) / 10, 1.5)
        lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(buf == 10), side="right") - 1, minlength=hi - lo)[: hi - lo] / n
        mean = np.bincount(w.doc, (w.end - w.start) * part, hi - lo) / 10
        base, own = (1 << WORD_BITS) + (1 << SHAPE_BITS), np.arange(hi - lo)
        yield (
            lo, hi,
            np.concatenate([w.doc, w.doc, own, own, own, own]),
            np.concatenate([word, shape, own * 0 + base, own * 0 + base + 1, own * 0 + base + 2, own * 0 + base + 3]),
            np.concatenate([part, part, size, np.minimum(lines, 2), np.minimum(mean, 3), again * 3]),
        )


def tails(texts: pa.Array, model: Model) -> np.ndarray:
    """P(grade > k) for each text and each threshold."""
    x = np.zeros(len(texts))
    for lo, hi, doc, cell, value in _cells(texts):
        x[lo:hi] = np.bincount(doc, value * model.weights[cell], hi - lo)
    return 1 / (1 + np.exp(-np.clip(x[:, None] - model.thresholds, -40, 40)))


def features(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The distinct features of each text, as lists of their numbers and of their summed values."""
    begin, cells, values = [np.zeros(1, np.int64)], [], []
    for lo, hi, doc, cell, value in _cells(texts):
        key, back = np.unique(doc * np.int64(SIZE) + cell, return_inverse=True)
        begin.append(np.searchsorted(key, np.arange(1, hi - lo + 1) * SIZE) + begin[-1][-1])
        cells.append((key % SIZE).astype(np.int32))
        values.append(np.bincount(back, value).astype(np.float32))
    at = pa.array(np.concatenate(begin).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([*cells, np.zeros(0, np.int32)]))), pa.ListArray.from_arrays(at, pa.array(np.concatenate([*values, np.zeros(0, np.float32)])))


def fit(begin: np.ndarray, cell: np.ndarray, value: np.ndarray, grades: np.ndarray, decay: float = 1e-6, rounds: int = 500, rate: float = 1.0) -> Model:
    """Maximum likelihood with ordered thresholds: the first and positive steps. One grade or none: no thresholds.

    Row i has the features begin[i] to begin[i + 1].
    """
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return Model(grades=levels)
    y = np.searchsorted(levels, grades)
    doc = np.repeat(np.arange(len(y)), np.diff(begin))
    cell, value = cell.astype(np.int64), value.astype(float)
    over = y[:, None] > np.arange(len(levels) - 1)
    share = np.clip(over.mean(0), 1e-3, 1 - 1e-3)
    first, steps = -np.log(share[0] / (1 - share[0])), np.zeros(len(levels) - 2)
    w, sq, sq_t = np.zeros(SIZE), np.full(SIZE, 1e-8), np.full(len(levels) - 1, 1e-4)
    for _ in range(rounds):
        theta = first + np.concatenate([[0], np.cumsum(np.log1p(np.exp(steps)))])
        x = np.bincount(doc, value * w[cell], len(y))
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - theta, -40, 40)))
        up, down = np.hstack([np.ones((len(y), 1)), p]), np.hstack([p, np.zeros((len(y), 1))])
        at = np.arange(len(y))
        hi, lo = up[at, y], down[at, y]
        own = np.maximum(hi - lo, 1e-9)
        # log-likelihood log(F(x - theta_{y-1}) - F(x - theta_y))
        dhi, dlo = hi * (1 - hi) / own, lo * (1 - lo) / own
        gx = (dhi - dlo) / len(y)
        g = np.bincount(cell, value * gx[doc], SIZE) - decay * w
        gt = np.zeros(len(levels) - 1)
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, -dhi, 0) / len(y))
        np.add.at(gt, np.minimum(y, len(levels) - 2), np.where(y < len(levels) - 1, dlo, 0) / len(y))
        later = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([[later[0]], later[1:] / (1 + np.exp(-steps))])
        sq, sq_t = sq + g**2, sq_t + grad**2
        w += rate * g / np.sqrt(sq)
        move = rate * 0.3 * grad / np.sqrt(sq_t)
        first, steps = first + move[0], steps + move[1:]
    return Model(w, first + np.concatenate([[0], np.cumsum(np.log1p(np.exp(steps)))]), levels)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, values = features(batch.column(2))
        size = pa.array(np.diff(cells.offsets.to_numpy()).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, cells, values], ["doc_id", "grade", "size", "cells", "values"])


def train(docs: DataFrame, ratings: DataFrame, per_grade: int = 2500, most_features: int = 3_000_000, **how) -> Model:
    """Fits on at most `per_grade` rated rows of each grade that are not held out; `ratings` has doc_id and grade.

    The executors read the texts and send numbered features, of all rows `most_features` together, whatever
    the texts' length. A doc_id with several grades counts with the least, null grades not at all.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = narrow(ratings, "doc_id", "grade").where(F.col("grade").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.col("grade").cast("int"))
    ids = F.broadcast(sample_of_each(marks.groupBy("doc_id").agg(F.min("grade").alias("grade")), "doc_id", "grade", per_grade))  # at most `per_grade` ids a grade
    made = own.join(ids, "doc_id").select("doc_id", "grade", "text").mapInArrow(_featured, "doc_id long, grade int, size long, cells array<int>, values array<float>")
    rows = gathered(made, "size", most_features)
    cells, values = (rows[c].combine_chunks() for c in ("cells", "values"))
    begin = np.concatenate([[0], np.cumsum(rows["size"].to_numpy())])
    return fit(begin, cells.flatten().to_numpy(), values.flatten().to_numpy(), rows["grade"].to_numpy(), **how)


def over(model: Model, grade: int) -> Column:
    """P(grade > `grade`) of a graded row, whichever grades the model has seen; 0 if it has seen none."""
    k = sum(g <= grade for g in model.grades)
    if 0 < k < len(model.grades):
        return F.get("tails", F.lit(k - 1))
    return F.lit(1.0 if model.grades and k == 0 else 0.0)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade and `tails`, the probabilities of a grade over each but the last, from the text alone.

    Null and empty texts are graded by their length alone; repeated rows get the same grade. Where one grade
    was seen all have it, where none was, the expected grade is 0.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p = tails(batch.column(1), m)
            mean = m.grades[0] + p @ np.diff(m.grades) if m.grades else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(mean, float)), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return own.mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")
