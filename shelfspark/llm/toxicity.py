"""A toxicity classifier fitted with a counterfactual penalty.

Features are the words of a text and their prefixes, hashed, each once a text. Besides the log loss the
fit penalises the squared change of score between twins of a labelled sentence, so that naming a group
moves no score by itself. Twins of a sentence with identity terms have each swapped for another of its
kind; twins of one without name one of two groups at its end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import gathered, held_out, narrow, sample_of_each
from shelfspark.llm.words import Words, chunks

BITS = 20
PREFIXES = (4, 5, 6)
#: Terms that may stand for one another, by language and number.
IDENTITY = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "women", "men", "immigrants", "foreigners", "gays", "lesbians"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "gay", "lesbian", "transgender", "black", "white", "asian", "african", "arab", "latino"),
    ("musulmans", "chrétiens", "juifs", "femmes", "hommes", "immigrés", "étrangers"),
    ("muslime", "christen", "juden", "frauen", "männer", "einwanderer", "ausländer"),
    ("musulmanes", "cristianos", "judíos", "mujeres", "hombres", "inmigrantes", "extranjeros"),
)


@dataclass
class Model:
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.slots] = self.weights
        return out


def _text_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text of a run, and the slots and texts of their features, in the texts' order of words."""
    shift = np.uint64(64 - BITS)
    for lo, hi, buf, offsets in chunks(texts, "utf8"):
        # punctuation ends a word, so that a comma hides none
        buf = buf.copy()
        buf[(buf < 128) & ~_ALNUM[buf]] = 32
        w = Words(buf, offsets)
        kinds = [w.hashes(), *(w.prefixes(k) for k in PREFIXES)]
        yield lo, hi, np.stack([(h >> shift).astype(np.int64) for h in kinds], 1), w.doc


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ALNUM[128:] = True


def score_texts(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Scores from 0 to 1. A feature counts once a text however often it comes; an empty text has the bias alone."""
    out = np.full(len(texts), bias)
    for lo, hi, slots, doc in _text_features(texts):
        w = table[slots]
        hit, kind = np.nonzero(w)
        key = np.unique(doc[hit] * np.int64(1 << BITS) + slots[hit, kind])
        out[lo:hi] += np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def doc_slots(texts: pa.Array) -> pa.ListArray:
    """The distinct features of each text, sorted."""
    begin, found = [np.zeros(1, np.int64)], []
    for lo, hi, slots, doc in _text_features(texts):
        key = np.unique((doc[:, None] * np.int64(1 << BITS) + slots).ravel())
        begin.append(np.searchsorted(key, np.arange(1, hi - lo + 1) << BITS) + begin[-1][-1])
        found.append((key & ((1 << BITS) - 1)).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(begin).astype(np.int32)), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))


_TERM = re.compile(r"[^\W_]+")


def twins(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> tuple[str, str]:
    """Two texts that differ in the groups they name only: the text and the same with each term swapped, or,
    where it names none, the text with either of two terms added. The text itself draws the terms."""
    turn = zlib.crc32(text.encode("utf-8", "replace"))
    kind = {t: group for group in terms for t in group}
    other = lambda t: (g := kind[t])[(g.index(t) + 1 + turn % (len(g) - 1)) % len(g)]
    low = text.lower()
    new = _TERM.sub(lambda m: other(m[0]) if m[0] in kind else m[0], low)
    if new != low:
        return low, new
    group = terms[turn % len(terms)]
    one = group[(turn >> 8) % len(group)]
    return f"{low} {one}", f"{low} {other(one)}"


def identity_slots(terms: tuple[tuple[str, ...], ...] = IDENTITY) -> np.ndarray:
    """The features of all identity terms."""
    return np.unique(doc_slots(pa.array([t for group in terms for t in group], pa.large_string())).values.to_numpy()).astype(np.int64)


def swap_change(rows: pa.Table, model: Model) -> float:
    """The mean change of score between the twins of the rows."""
    table, scores = model.table(), []
    for name in ("one", "two"):
        column = rows[name].combine_chunks()
        row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        scores.append(1 / (1 + np.exp(-np.clip(np.bincount(row, table[column.flatten().to_numpy()], len(column)) + model.bias, -40, 40))))
    return float(np.abs(scores[0] - scores[1]).mean()) if rows.num_rows else 0.0


def fit(rows: pa.Table, penalty: float = 1.0, decay: float = 2e-3, kept: int = 20_000, least: int = 4, rounds: int = 400, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """Logistic regression over the `kept` features that tell the labels apart best, each in `least` texts at least.

    `rows` has the label `toxic` and the features of the row's twins, `one` and `two`; the label is that of
    `one`, the text with the groups it names, or with one added. The features of identity terms are always in
    the model, so that their weights are learned from labelled sentences, and the penalty holds the twins of
    every sentence together. Without rows of both labels the model is a low or high constant.
    """
    y = rows["toxic"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(bias=4.0 if len(y) and y.min() == 1 else -4.0)

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows[name].combine_chunks()
        return column.flatten().to_numpy(), np.repeat(np.arange(len(column), dtype=np.int32), np.diff(column.offsets.to_numpy()))

    slot, row = lists("one")
    pos = np.bincount(slot[y[row] == 1], minlength=1 << BITS)
    neg = np.bincount(slot[y[row] == 0], minlength=1 << BITS)
    n1, n0 = y.sum(), len(y) - y.sum()
    a, b = pos + 0.5, neg + 0.5
    z = (np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))) / np.sqrt(1 / a + 1 / b)
    able = np.flatnonzero((pos + neg >= least) & (np.abs(z) > 2.5))
    slots = np.union1d(able[np.argsort(-np.abs(z[able]), kind="stable")[:kept]], identity_slots(terms))
    place = np.full(1 << BITS, -1, np.int64)
    place[slots] = np.arange(len(slots))

    def used(slot: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = place[slot]
        return at[at >= 0], row[at >= 0]

    one_col, one_row = col, row = used(slot, row)
    two_col, two_row = used(*lists("two"))
    w, bias, step = np.zeros(len(slots)), float(np.log(n1 / n0)), 0.5
    sq, sq_b = np.full(len(slots), 1e-4), 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + bias, -40, 40)))
        gap = (p - y) / len(y)
        change = (np.bincount(one_row, w[one_col], len(y)) - np.bincount(two_row, w[two_col], len(y))) * 2 * penalty / len(y)
        g = np.bincount(col, gap[row], len(slots)) + decay / max(len(slots), 1) ** 0.5 * w
        g += np.bincount(one_col, change[one_row], len(slots)) - np.bincount(two_col, change[two_row], len(slots))
        gb = gap.sum()
        sq, sq_b = sq + g**2, sq_b + gb**2
        w -= step * g / np.sqrt(sq)
        bias -= step * gb / np.sqrt(sq_b)
    return Model(slots, w, bias)


def _featured(batches: Iterator[pa.RecordBatch], terms: tuple[tuple[str, ...], ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = zip(*(twins(t or "", terms) for t in batch.column(2).to_pylist()), strict=True) if batch.num_rows else ((), ())
        lists = [doc_slots(pa.array(x, pa.large_string())) for x in (one, two)]
        size = pa.array(sum(np.diff(x.offsets.to_numpy()) for x in lists).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, *lists], ["doc_id", "toxic", "size", "one", "two"])


def examples(docs: DataFrame, labels: DataFrame, most: int = 4000, most_features: int = 12_000_000, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> pa.Table:
    """The features that `fit` takes, of at most `most` labelled rows of each label that are not held out, the same bound for any size.

    The executors read the texts and send numbered features, of all rows `most_features` together, whatever
    the texts' length. A doc_id with both labels counts as toxic; other labels count not at all.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = narrow(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    ids = F.broadcast(sample_of_each(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "toxic", most))  # at most `most` ids a label
    made = own.join(ids, "doc_id").select("doc_id", "toxic", "text").mapInArrow(partial(_featured, terms=terms), "doc_id long, toxic int, size long, one array<int>, two array<int>")
    return gathered(made, "size", most_features)


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, most_features: int = 12_000_000, terms: tuple[tuple[str, ...], ...] = IDENTITY, **how) -> Model:
    """The model fitted on `examples`."""
    return fit(examples(docs, labels, most, most_features, terms), terms=terms, **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row from its text alone; null and empty texts score the model's base rate."""
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), table, sent.value.bias))], ["doc_id", "score"])

    return own.mapInArrow(run, "doc_id long, score double")
