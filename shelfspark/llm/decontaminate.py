"""Benchmark passages in documents by spaced seeds.

A mask keeps some of consecutive words and ignores the others, so a seed still hits where an ignored word
was replaced. Hashes of masked windows of the test items are joined with those of the documents; around
each hit the two texts are compared word by word along the diagonal, and an overlap counts if it is long
enough and enough of its words agree.

A hit next to one on the same diagonal says nothing new, so of a row of hits only the first is made: text
that repeats itself costs a hit a diagonal, not one a pair of places. Test items up to a size in bytes are
sent to the executors as an index; larger ones meet the documents in a Spark join on seeds.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import BROADCAST_BYTES, Tables, bound_batches, narrow
from shelfspark.llm.words import _M1, Words, chunks, mix

#: 1: the word counts, 0: any word. However the words that differ lie, some mask hits every overlap of
#: LEAST_WORDS and LEAST_SHARE: so for all of 10 to 31 words (tested), and a longer one has a part of 16 to
#: 31 words with at least its share.
MASKS = ("101111", "10111001", "111000101", "111010001", "101001011")
LEAST_WORDS = 10
LEAST_SHARE = 0.75
#: Test text in bytes that is sent as an index; an index takes some eight times as much.
INDEXED_BYTES = BROADCAST_BYTES // 8
#: Hits, and words on diagonals, that are compared at once; documents' windows of one seed, and items of one
#: document, that one task takes.
AT_ONCE, SHARE, ITEMS = 2_000_000, 50_000, 500


@dataclass
class Items:
    """Test items as word hashes, and the windows of all of them, in the order of their seed and the seed before."""

    ids: np.ndarray
    first: np.ndarray
    words: np.ndarray
    masks: tuple[str, ...]
    seeds: np.ndarray  # distinct, sorted
    bounds: np.ndarray  # windows of each seed
    pairs: np.ndarray  # seed and seed before, as one number
    item: np.ndarray
    place: np.ndarray


def seeds_of(h: np.ndarray, first: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of every window that lies within one text, and where it begins."""
    n, span = len(h), len(mask)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = n - span + 1
    out = np.full(m, salt + 1, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out = out * _M1 + h[j : j + m]
    at = np.arange(m)
    left = np.repeat(first[1:], np.diff(first))[:m] - at  # words to the end of the text
    inside = left >= span
    return mix(out[inside]), at[inside]


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    for lo, hi, buf, offsets in chunks(texts, "utf8"):
        buf = buf.copy()
        buf[(buf < 128) & ~_WORD[buf]] = 32  # marks separate words
        w = Words(buf, offsets)
        yield lo, hi, w, w.hashes()


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True


def before(s: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each window whether the one before it is the window one word earlier in the same text."""
    out = np.zeros(len(s), bool)
    out[1:] = (at[1:] == at[:-1] + 1) & (of[1:] == of[:-1])
    return out


def item_windows(h: np.ndarray, first: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Seeds of all windows, whether one is before it, its seed, and the windows' items and places.

    An item shorter than a mask's span has, besides, one window of all its words.
    """
    n = np.diff(first)
    parts = []
    for k, mask in enumerate(masks):
        s, at = seeds_of(h, first, mask, k)
        of = np.searchsorted(first, at, side="right") - 1
        if k >= len(MASKS):
            own = n[of] == len(mask)
            s, at, of = s[own], at[own], of[own]
        has = before(s, at, of)
        parts.append((s, has, np.where(has, np.roll(s, 1), np.uint64(0)), of, at - first[of]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def masks_for(lengths: np.ndarray) -> tuple[str, ...]:
    """MASKS, and a plain one for each shorter length of an item."""
    return (*MASKS, *("1" * n for n in sorted({int(n) for n in lengths if 0 < n < max(map(len, MASKS))})))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, first = [], [0]
    for _, _, w, h in _word_hashes(texts):
        words.append(h)
        first += (first[-1] + w.first[1:]).tolist()
    return np.concatenate([*words, np.zeros(0, np.uint64)]), np.array(first)


def index(ids: list[int], texts: list[str | None]) -> Items:
    words, first = _hashed(pa.array(texts, pa.string()))
    masks = masks_for(np.diff(first))
    s, has, prev, item, place = item_windows(words, first, masks)
    seeds, rank = np.unique(s, return_inverse=True)
    pair = rank * (len(seeds) + 1) + np.where(has, np.searchsorted(seeds, prev) + 1, 0)
    order = np.argsort(pair, kind="stable")
    return Items(np.array(ids, np.int64), first, words, masks, seeds, np.searchsorted(rank[order], np.arange(len(seeds) + 1)), pair[order], item[order], place[order])


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] and the n[0] - 1 numbers after it, and so on."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def best_overlaps(same: np.ndarray, n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each diagonal (n words of `same`) the run with most agreeing words of which at least `share` agree.

    Agreeing words, first word and length; runs begin and end with an agreeing word. A run may be if its gain,
    1 - share for a word that agrees and -share for another, is not negative.
    """
    begin, seg = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n)
    cost = round(1000 * share)
    gain = np.where(same, 1000 - cost, -cost).astype(np.int64)
    after = np.cumsum(gain)
    prior = after - gain
    apart = int(after.max(initial=0) - min(0, prior.min(initial=0), after.min(initial=0))) + 1001
    low = np.minimum.accumulate(prior - seg * apart)  # falls from one diagonal to the next, so it begins anew in each
    start = np.searchsorted(-low, -(after - seg * apart), side="left")  # the longest run that ends here
    agree = np.concatenate([[0], np.cumsum(same)])
    count = np.where(start <= np.arange(len(same)), agree[1:] - agree[np.minimum(start, len(same))], 0)
    most = np.maximum.reduceat(count, begin)
    ends = np.flatnonzero(count == most[seg])
    ends = ends[np.searchsorted(seg[ends], np.arange(len(n)))]
    there = np.flatnonzero(same)
    at = np.minimum(start[ends], len(same) - 1)
    first = there[np.minimum(np.searchsorted(there, at), max(len(there) - 1, 0))] if len(there) else at
    return most, first - begin, ends - first + 1


def verified(h: np.ndarray, first: np.ndarray, x: Items, hits: np.ndarray, least_words: int, least_share: float) -> np.ndarray:
    """(text, item, agreeing words, first word, length) of all overlaps on the diagonals (text, item, text's place less item's).

    A diagonal may have several: what is left of it before and after one is looked at again.
    """
    out = [np.zeros((0, 5), np.int64)]
    a = x.first[hits[:, 1]]
    lo, hi = np.maximum(0, first[hits[:, 0]] - hits[:, 2]), np.minimum(x.first[hits[:, 1] + 1] - a, first[hits[:, 0] + 1] - hits[:, 2])
    need = np.minimum(least_words, x.first[hits[:, 1] + 1] - a)
    own = np.arange(len(hits))
    while len(own):
        more_own, more_lo, more_hi = [], [], []
        ends, i = np.cumsum(hi - lo), 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - (hi[i] - lo[i]) + AT_ONCE, side="right")))
            o, n = own[i:j], (hi - lo)[i:j]
            at = _spans(lo[i:j], n)
            same = h[at + np.repeat(hits[o, 2], n)] == x.words[at + np.repeat(a[o], n)]
            enough = np.add.reduceat(same, np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.int64) >= need[o]
            if enough.any():
                o, s, e, n, same = o[enough], lo[i:j][enough], hi[i:j][enough], n[enough], same[np.repeat(enough, n)]
                agree, begin, size = best_overlaps(same, n, least_share)
                ok = agree >= need[o]
                o, s, e, agree, begin, size = o[ok], s[ok], e[ok], agree[ok], begin[ok] + s[ok], size[ok]
                out.append(np.stack([hits[o, 0], hits[o, 1], agree, begin + hits[o, 2] - first[hits[o, 0]], size], 1))
                more_own += [o, o]
                more_lo += [s, begin + size]
                more_hi += [begin, e]
            i = j
        own, lo, hi = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in (more_own, more_lo, more_hi))
        left = hi - lo >= np.maximum(need[own], 1)
        own, lo, hi = own[left], lo[left], hi[left]
    return apart(np.concatenate(out))


def apart(found: np.ndarray) -> np.ndarray:
    """Of overlaps of a text and an item that share words of the text, the one with most agreeing words, then the first."""
    if len(found) < 2:
        return found
    found = np.unique(found, axis=0)
    found = found[np.lexsort((found[:, 4], found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
    new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])
    alone = new & np.concatenate([new[1:], [True]])
    keep = alone.copy()
    taken: list[int] = []
    for i in np.flatnonzero(~alone).tolist():
        if new[i]:
            taken = []
        s, e = int(found[i, 3]), int(found[i, 3] + found[i, 4])
        k = bisect.bisect_right(taken, s)  # begins and ends in turn; an odd place lies inside one
        if k % 2 == 0 and (k == len(taken) or taken[k] >= e):
            taken[k:k] = [s, e]
            keep[i] = True
    return found[keep]


def _hits(w: Words, h: np.ndarray, x: Items, table: np.ndarray) -> Iterator[np.ndarray]:
    """(text, item, diagonal) of windows that share a seed, but where the windows before them do too; some twice."""
    for k, mask in enumerate(x.masks):
        s, at = seeds_of(h, w.first, mask, k)
        may = np.flatnonzero(table[(s >> np.uint64(42)).astype(np.int64)])
        rank = np.minimum(np.searchsorted(x.seeds, s[may]), len(x.seeds) - 1)
        true = x.seeds[rank] == s[may]
        may, rank = may[true], rank[true]
        if not len(may):
            continue
        has = before(s, at, w.doc[at])[may]
        prior = s[np.maximum(may - 1, 0)]
        prior_rank = np.minimum(np.searchsorted(x.seeds, prior), len(x.seeds) - 1)
        has &= x.seeds[prior_rank] == prior
        pair = rank * (len(x.seeds) + 1) + np.where(has, prior_rank + 1, 0)
        lo, hi = x.bounds[rank], x.bounds[rank + 1]
        skip, on = np.where(has, np.searchsorted(x.pairs, pair, side="left"), lo), np.where(has, np.searchsorted(x.pairs, pair, side="right"), lo)
        begin, n, at = np.concatenate([lo, on]), np.concatenate([skip - lo, hi - on]), np.tile(at[may], 2)
        ends, i = np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + AT_ONCE, side="right")))
            which, here = _spans(begin[i:j], n[i:j]), np.repeat(at[i:j], n[i:j])
            if len(which):
                yield np.unique(np.stack([w.doc[here], x.item[which], here - x.place[which]], 1), axis=0)
            i = j


def _scan(texts: pa.Array, x: Items, least_words: int, least_share: float) -> Iterator[np.ndarray]:
    """Overlaps of runs of texts."""
    if not len(x.seeds):
        return
    # a small table of seeds' top bits: most windows of a document hit no item
    table = np.zeros(1 << 22, bool)
    table[(x.seeds >> np.uint64(42)).astype(np.int64)] = True
    for lo, _, w, h in _word_hashes(texts):
        parts = list(_hits(w, h, x, table))
        if parts:
            hits = np.unique(np.concatenate(parts), axis=0) if len(parts) > 1 else parts[0]
            found = verified(h, w.first, x, hits, least_words, least_share)
            yield found + np.array([lo, 0, 0, 0, 0])


OUT = "doc_id long, item_id long, n_match long, start_word long, n_words long"
NAMES = ["doc_id", "item_id", "n_match", "start_word", "n_words"]


def _find(batches: Iterator[pa.RecordBatch], sent, least_words: int, least_share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in _scan(batch.column(1), sent.value, least_words, least_share):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[:, 0])), pa.array(sent.value.ids[found[:, 1]]), *(pa.array(found[:, c]) for c in (2, 3, 4))], NAMES)


def _clean(batches: Iterator[pa.RecordBatch], sent, at: int, least_words: int, least_share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for found in _scan(batch.column(at), sent.value, least_words, least_share):
            keep[found[:, 0]] = False
        yield batch.filter(pa.array(keep))


def _items(benchmark: DataFrame) -> DataFrame:
    own = narrow(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return own.where(F.col("item_id").isNotNull() & (F.length("text") > 0))


def _sent(items: DataFrame, most_bytes: int):
    """The index of all items as a broadcast, or None if their text is over the bound."""
    if items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] > most_bytes:
        return None
    rows = items.orderBy("item_id", "text").toArrow()
    return items.sparkSession.sparkContext.broadcast(index(rows["item_id"].to_pylist(), rows["text"].to_pylist()))


SEEDS = "seed long, prior long, id long, place long"


def _seed_rows(ids: pa.Array, texts: pa.Array, masks: tuple[str, ...], whole: bool) -> Iterator[pa.RecordBatch]:
    for lo, hi, w, h in _word_hashes(texts):
        if whole:
            s, has, prev, of, place = item_windows(h, w.first, masks)
        else:
            parts = []
            for k, mask in enumerate(masks):
                s, at = seeds_of(h, w.first, mask, k)
                has = before(s, at, w.doc[at])
                parts.append((s, has, np.where(has, np.roll(s, 1), np.uint64(0)), w.doc[at], at - w.first[w.doc[at]]))
            s, has, prev, of, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(prev.view(np.int64), mask=~has), ids.slice(lo, hi - lo).take(pa.array(of)), pa.array(place)], ["seed", "prior", "id", "place"])


def _windows(rows: DataFrame, masks: tuple[str, ...], whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _seed_rows(batch.column(0), batch.column(1), masks, whole)

    return rows.select("id", "text").mapInArrow(run, SEEDS)


def _verify(batches: Iterator[pa.RecordBatch], least_words: int, least_share: float) -> Iterator[pa.RecordBatch]:
    """Rows (text, and items with their text and diagonals) to overlaps."""
    for batch in batches:
        for i, (uid, text, items) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            x = index([t["item"] for t in items], [t["item_text"] for t in items])
            h, first = _hashed(pa.array([text], pa.string()))
            hits = np.array([(0, k, d) for k, t in enumerate(items) for d in t["diagonals"]], np.int64).reshape(-1, 3)
            found = verified(h, first, x, hits, least_words, least_share)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), uid)), pa.array(x.ids[found[:, 1]]), *(pa.array(found[:, c]) for c in (2, 3, 4))], ["id", "item", *NAMES[2:]])


def _joined(docs: DataFrame, items: DataFrame, least_words: int, least_share: float) -> DataFrame:
    """(id, item, ...) of overlaps of rows (id, text) with items (id, text), without an index of all items.

    Windows meet in a join on seeds. A seed that many windows of documents have is dealt to several
    tasks, with its items in each, and so is a document with many items.
    """
    tables, count = Tables(docs.sparkSession), F.count("*").alias("n")
    lengths = items.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(np.unique(np.diff(_hashed(b.column(1))[1])))], ["n"]) for b in it), "n long").where(f"n < {max(map(len, MASKS))}").distinct()
    masks = masks_for(np.array([r[0] for r in lengths.collect()]))  # at most as many as a mask is long
    theirs = tables.save(_windows(items, masks, True))
    ours = tables.save(_windows(docs, masks, False).join(theirs.select("seed").distinct(), "seed", "left_semi"))
    often = ours.groupBy("seed").agg((1 + F.floor(F.count("*") / SHARE)).alias("parts")).where("parts > 1")
    left = ours.join(often, "seed", "left").select("seed", F.col("prior").alias("p"), F.col("id").alias("doc"), F.col("place").alias("at"), F.pmod(F.xxhash64("id", "place"), F.coalesce("parts", F.lit(1))).alias("part"))
    right = theirs.join(often, "seed", "left").select("seed", F.col("prior").alias("q"), F.col("id").alias("item"), "place", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = left.join(right, ["seed", "part"]).where(~F.coalesce(F.col("p") == F.col("q"), F.lit(False))).select("doc", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    lots = tables.save(met.groupBy("doc", "item").agg(F.collect_list("diagonal").alias("diagonals")))  # at most as many as both have words
    parts = lots.groupBy("doc").agg((1 + F.floor(F.count("*") / ITEMS)).alias("parts"))
    full = lots.join(parts, "doc").join(items.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
    dealt = full.groupBy("doc", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("item", "item_text", "diagonals")).alias("items"))
    pairs = dealt.join(docs.select(F.col("id").alias("doc"), "text"), "doc").select("doc", "text", "items")
    return pairs.mapInArrow(partial(_verify, least_words=least_words, least_share=least_share), "id long, item long, n_match long, start_word long, n_words long")


def _numbered(rows: DataFrame, tables: Tables) -> DataFrame:
    """The rows, saved, with a number `_row` each."""
    return tables.save(rows.withColumn("_row", F.monotonically_increasing_id()))


def find(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, most_bytes: int = INDEXED_BYTES) -> DataFrame:
    """A row for each overlap of a document and a test item: agreeing words, first word in the document and length.

    An overlap has `least_words` agreeing words, or all of a shorter item's, and at most a share of
    1 - `least_share` that differ. At the defaults, or stricter values, no document and item that overlap are
    missed. A document may overlap with an item in several places; of overlaps that share words of the
    document the one with most agreeing words stays. Null and empty texts and items overlap with nothing, nor do
    items without an id. Repeated rows each give their rows, repeated items too. Test text over `most_bytes`
    is not broadcast: it meets the documents in a join.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = _items(benchmark)
    sent = _sent(items, most_bytes)
    if sent is not None:
        return own.mapInArrow(partial(_find, sent=sent, least_words=least_words, least_share=least_share), OUT)
    tables = Tables(docs.sparkSession)
    rows, tests = _numbered(own, tables), _numbered(items, tables)
    found = _joined(rows.select(F.col("_row").alias("id"), "text"), tests.select(F.col("_row").alias("id"), "text"), least_words, least_share)
    out = found.join(rows.select(F.col("_row").alias("id"), "doc_id"), "id").join(tests.select(F.col("_row").alias("item"), "item_id"), "item")
    return out.select(*NAMES)


def remove(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, least_item: int = 4, most_bytes: int = INDEXED_BYTES) -> DataFrame:
    """The rows that overlap with no test item, unchanged; items of fewer than `least_item` words are no evidence.

    Test text over `most_bytes` is not broadcast: it meets the documents in a join.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    items = _items(benchmark).where(F.size(F.filter(F.split(F.regexp_replace("text", "[\\x00-\\x7F&&[^A-Za-z0-9]]+", " "), " "), lambda w: w != "")) >= least_item)
    sent = _sent(items, most_bytes)
    if sent is not None:
        return docs.mapInArrow(partial(_clean, sent=sent, at=at, least_words=least_words, least_share=least_share), docs.schema)
    tables, names = Tables(docs.sparkSession), docs.columns
    rows = _numbered(docs.toDF(*(f"_{i}" for i in range(len(names)))), tables)
    found = _joined(rows.select(F.col("_row").alias("id"), F.col(f"_{at}").cast("string").alias("text")), _numbered(items, tables).select(F.col("_row").alias("id"), "text"), least_words, least_share)
    return rows.join(found.select(F.col("id").alias("_row")).distinct(), "_row", "left_anti").drop("_row").toDF(*names)
