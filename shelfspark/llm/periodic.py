"""Periodic runs of words: a suffix automaton whose ordered end-position sets are merged small to large.

A run is a stretch of words with smallest period q that no neighbouring word extends. Two neighbouring
positions of an end-position set, d apart, in a state of length m >= d spell a square: m + d words of period
d. A pair of neighbours is new in one state only, the one that is as long as the run less its period,
and there the square is the whole run; shorter states give its first parts, which are joined to it.

A run of at least `repeats` periods is made of word k-grams that come again one period away. Stretches
without such k-grams hold no run and are left out before the automaton is built, by hashes: a collision
costs time, never a run. Every document is a row of its own; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import narrow
from shelfspark.llm.words import Words, chunks, mix

#: The words of the operator, as a pattern of what parts them.
BLANKS = r"[\x20\x09-\x0D]+"


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for a clone) of every state."""
    steps: list[dict] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for i, word in enumerate(words):
        new, p = len(steps), last
        steps.append({})
        length.append(i + 1)
        end.append(i)
        link.append(0)
        while p >= 0 and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p >= 0:
            to = steps[p][word]
            if length[p] + 1 < length[to]:
                clone = len(steps)
                steps.append(steps[to].copy())
                length.append(length[p] + 1)
                end.append(-1)
                link.append(link[to])
                link[to] = clone
                while p >= 0 and steps[p].get(word) == to:
                    steps[p][word] = clone
                    p = link[p]
                to = clone
            link[new] = to
        last = new
    return length, link, end


def runs(words: list, repeats: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and `repeats` periods, by start, then period."""
    length, link, end = automaton(words)
    n = len(words)
    # positions count from the last word on, so that what prefixes add in turn goes to the end of a list
    ends: list = [[n - e] if e >= 0 else [] for e in end]
    fresh: list = [[] for _ in end]
    reach: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        m, own = length[v], ends[v]
        if not m:
            continue
        for x in fresh[v]:
            at = bisect_left(own, x)
            for near, far in ((own[at - 1], x) if at else (x, x), (x, own[at + 1]) if at + 1 < len(own) else (x, x)):
                d = far - near
                if d and d * (repeats - 1) <= m:
                    key = (n - far - m + 1, d)
                    reach[key] = max(reach.get(key, 0), n - near)
        up, other = link[v], ends[link[v]]
        if up:
            if len(other) > len(own):
                own, other = other, own
            if len(other) * 8 > len(own):
                own = sorted(own + other)
            else:
                for x in other:
                    insort(own, x)
            ends[up] = own
            fresh[up] += other
        ends[v] = fresh[v] = None
    found, last = [], {}
    for (start, d), stop in sorted(reach.items()):
        # neighbours that a child had already spell an inner part of a run that began before
        if stop > last.get(d, -1):
            last[d] = stop
            if stop - start + 1 >= max(least, repeats * d):
                found.append((start, stop - start + 1, d))
    return found


def _gram(repeats: int, least: int) -> int:
    """The most words that come again a period away in any run, however short."""
    return min(max(least, repeats * q) - q for q in range(1, least + 1))


def stretches(h: np.ndarray, first: np.ndarray, repeats: int, least: int, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of disjoint stretches of words outside which no run lies; h: word hashes, first: where texts begin.

    The first stretches are the texts. A word stays if a k-gram over it comes again in its stretch, at most
    the stretch's share of one period away.
    """
    k = _gram(repeats, least)
    lo, hi = first[:-1], first[1:]
    for _ in range(passes):
        long = hi - lo >= max(least, k + 1)
        lo, hi = lo[long], hi[long]
        if not len(lo):
            break
        size = hi - lo - k + 1
        begin = np.cumsum(size) - size
        part = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) - begin[part] + lo[part]
        gram = np.zeros(len(at), np.uint64)
        for j in range(k):
            gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + h[at + j])
        order = np.lexsort((gram, part))
        same = (gram[order][1:] == gram[order][:-1]) & (part[order][1:] == part[order][:-1])
        gap = at[order][1:] - at[order][:-1]
        near = same & (gap * repeats <= (hi - lo)[part[order][1:]])
        keep = np.zeros(len(at), bool)
        keep[order[1:][near]] = keep[order[:-1][near]] = True
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at[keep], 1)
        np.add.at(cover, at[keep] + k, -1)
        inside = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).view(np.int8), [0]])
        # a stretch never crosses the end of a text, as no k-gram does; touching ones of two texts are parted
        edge = np.diff(inside)
        cut = lo[(lo > 0) & (inside[lo] > 0) & (inside[lo + 1] > 0)]
        new_lo, new_hi = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
        done = len(new_lo) == len(lo) and (new_lo == lo).all() and (new_hi == hi).all()
        lo, hi = new_lo, new_hi
        if done:
            break
    return lo, hi


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch], repeats: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in chunks(batch.column(1)):
            w = Words(buf, offs)
            lo, hi = stretches(w.hashes(), w.first, repeats, least)
            by_doc = np.searchsorted(lo, w.first)
            raw = buf.tobytes()
            all_runs, texts = [], []
            for i in range(b - a):
                words, found = raw[offs[i] : offs[i + 1]].split(), []
                for s, e in zip((lo[by_doc[i] : by_doc[i + 1]] - w.first[i]).tolist(), (hi[by_doc[i] : by_doc[i + 1]] - w.first[i]).tolist(), strict=True):
                    found += [(s + start, size, q) for start, size, q in runs(words[s:e], repeats, least)]
                if found:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for start, size, q in found:
                        gone[start + q] += 1
                        gone[start + size] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(words))
            out = [batch.column(0).slice(a, b - a), pa.array(np.diff(w.first)), pa.array(all_runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame, repeats: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, all runs by start and period, and the text in which each run is cut to its first period.

    Words are `[^\\x20\\x09-\\x0D]+`; a run has at least `least` words and `repeats` of its smallest period. A word
    goes if it lies in any run after that run's first period; the kept ones are joined by one blank. One row
    for each row of the input: a null or empty text has no words, no runs and an empty text; repeated rows
    and null ids are rows of their own. Other columns take no part. A task holds one text at a time.
    """
    if repeats < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(partial(_found, repeats=repeats, least=least), SCHEMA)


def longest(runs: str = "runs") -> Column:
    """The run of greatest length, of such the first, of such the one with the smallest period; null if there is none."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))


def digest(found: DataFrame) -> DataFrame:
    """The columns of `op11_periodic` from those of `find`."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    one = found.withColumn("_top", longest())
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.back")).alias("start"), F.col("_top.length").alias("length"), (-F.col("_top.short")).alias("period"),
        F.expr("1000 * _top.length div -_top.short").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic tail in the tenth of the documents whose crc32(doc_id as text) ends in 0.

    With g that hash without its last digit and n words, words from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8)
    first of them. Other texts, null ones and those without words stay as they are.
    """
    own = narrow(docs, "doc_id", "text").withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    cut = own.withColumn("_words", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_words"))
    at = cut.withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.expr("CASE WHEN _n > 0 THEN CAST(_g % _n AS INT) END"))
    unit = at.withColumn("_p", F.expr("CAST(1 + (_n - _a) div (3 + _g % 8) AS INT)"))
    tail = "slice(flatten(array_repeat(slice(_words, _a + 1, _p), CAST(ceil((_n - _a) / _p) AS INT))), 1, _n - _a)"
    return unit.select("doc_id", F.expr(f"CASE WHEN _n > 0 THEN array_join(concat(slice(_words, 1, _a), {tail}), ' ') ELSE text END").alias("text"))
