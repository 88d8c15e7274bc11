"""Near-duplicate documents by an LSH forest over MinHash signatures.

Texts become sets of hashed word shingles; documents with the same set are one class. Each of TREES trees
orders the classes by its own DEPTH MinHash values. Classes that share the first LEAST values form a
region; a region of more than REGION is split by further values, as deep as it takes, and in what is left
each class meets its nearest neighbours in the order. Candidates are checked on full sets, and links are
joined to components.

Near copies in their thousands would give all pairs. In a dense region only a spanning forest of the most
similar pairs is checked first, and a region too large for one task is dealt out. Where the members of a
dense or crowded region do not end in one component, those outside the largest are compared with the hubs
and then, by a join on rare shingles, with all others on full sets, so the outcome is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.core import Tables, bound_batches, narrow
from shelfspark.llm.words import Words, chunks, mix, shingles

TREES, DEPTH, LEAST, REGION, NEAR = 16, 8, 3, 256, 8
#: Rows of one region that one task takes; larger regions go by full order and are dealt out.
HOT = 20_000
#: Pairs a class has in a region before only a spanning forest of them is checked.
DENSE = 6
#: Hubs of a crowded region that its members are compared with first, and parts that a hub's comparisons are dealt to.
HUBS, DEAL = 4, 64
#: Sets that shingles are counted in, for the order of the join on rare ones, and shingles that are remembered.
COUNTED, COMMON = 20_000, 300_000
#: Sets with one shingle that one task compares.
SHARE = 2_000
#: Nodes that a task contracts edges of at once, which bounds its memory.
CONTRACTED = 500_000
HASHES = TREES * DEPTH
SKETCH = 64
_A = np.random.default_rng(99).integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(98).integers(0, 2**32, HASHES, dtype=np.uint32)


def _sets(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text's begin."""
    parts = [np.unique(h[s:e]) for s, e in zip(begin[:-1], begin[1:], strict=True)]
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _named(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each set; 0 of an empty one."""
    n = np.diff(begin)
    full = np.flatnonzero(n)
    h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    if len(full):
        starts = begin[:-1][full]
        h1[full] = np.add.reduceat(mix(h), starts).view(np.int64)
        h2[full] = np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), starts).view(np.int64)
    return n, h1, h2


def signatures(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values (texts, HASHES) of non-empty sets."""
    out, high = np.empty((HASHES, len(begin) - 1), np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for f in range(HASHES):
        np.minimum.reduceat((high ^ _B[f]) * _A[f], begin[:-1], out=out[f])
    return np.ascontiguousarray(out.T)


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in chunks(batch.column(1), "ascii"):
            h, begin = _sets(*shingles(Words(buf, offsets), k))
            n, h1, h2 = _named(h, begin)
            full = np.flatnonzero(n)
            sig = [None] * (hi - lo)
            if len(full):
                s = signatures(h, np.append(begin[:-1][full], len(h)))
                for i, row in zip(full.tolist(), s, strict=True):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in chunks(batch.column(1), "ascii"):
            h, begin = _sets(*shingles(Words(buf, offsets), k))
            sets = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets, *map(pa.array, _named(h, begin))], ["doc", "items", "n", "h1", "h2"])


def _region_of(sig: np.ndarray) -> np.ndarray:
    """(rows, TREES): a tree and its first LEAST values."""
    out = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(sig), 1))
    for d in range(LEAST):
        out = mix(out * np.uint64(31) + sig[:, :, d])
    return out


def _regions(batches: Iterator[pa.RecordBatch], crowds=None) -> Iterator[pa.RecordBatch]:
    """Regions of each class; with `crowds`, a broadcast table of 2**24 bits, only those whose bit is set."""
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            region, each = _region_of(sig).reshape(-1), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES)
            if crowds is not None:
                at = region & np.uint64((1 << 24) - 1)
                in_ = (crowds.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                region, each = region[in_], each[in_]
            yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(each)], ["region", "doc"])


def _bits(ids: DataFrame, name: str) -> np.ndarray:
    """A table of 2**24 bits, as 2**18 longs, with the lowest bits of each id set."""
    at = ids.select(F.expr(f"{name} & {(1 << 24) - 1}").alias("at"))
    rows = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")).toArrow()
    out = np.zeros(1 << 18, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
        m = len(sig)
        sketch = np.ascontiguousarray(sig.reshape(m, HASHES)[:, :: HASHES // SKETCH].astype(np.uint8))
        region = _region_of(sig)
        # the order of keys is only to bring equal beginnings together: big-endian bytes sort like numbers
        keys = np.ascontiguousarray(sig.astype(">u4")).view(np.uint8).reshape(m * TREES, 4 * DEPTH)
        each = np.repeat(np.arange(m), TREES)
        fixed = lambda a, n: pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * n).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(region.reshape(-1).view(np.int64)), fixed(keys, 4 * DEPTH), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[each]), pa.array(batch.column(1).to_numpy(zero_copy_only=False)[each]), fixed(sketch[each], SKETCH)],
            ["region", "key", "doc", "n", "sketch"],
        )


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _agreeing(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 100_000):
        e = s + 100_000
        out[s:e] = (sketch[i[s:e]] == sketch[j[s:e]]).sum(1)
    return out


def _least_agreeing(percent: int) -> int:
    """Sketch positions that a pair at the threshold has but for 4.5 standard deviations."""
    p = percent / 100
    return int(SKETCH * p - 4.5 * (SKETCH * p * (1 - p)) ** 0.5)


def region_pairs(region: np.ndarray, keys: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows, how many sketch positions agree, and the run each pair is of. Rows come sorted by region and key."""
    m = len(region)
    new = np.ones(m, bool)
    new[1:] = region[1:] != region[:-1]
    for d in range(LEAST, DEPTH):  # as deep as a region needs
        run = np.cumsum(new) - 1
        big = np.bincount(run)[run] > REGION
        if not big.any():
            break
        new[1:] |= big[1:] & (keys[1:, d] != keys[:-1, d])
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    found_i, found_j, found_s = [], [], []
    small, large = n.astype(np.int64) * 100, n.astype(np.int64) * percent
    for o in range(1, min(int(size.max()) if m else 0, REGION + 1)):
        i = np.flatnonzero((run[:-o] == run[o:]) | (region[:-o] == region[o:] if o <= NEAR else False))
        if not len(i):
            continue
        j = i + o
        ok = np.minimum(small[i], small[j]) >= np.maximum(large[i], large[j])
        i, j = i[ok], j[ok]
        s = _agreeing(sketch, i, j)
        ok = s >= _least_agreeing(percent)
        found_i.append(i[ok])
        found_j.append(j[ok])
        found_s.append(s[ok])
    if not found_i:
        return *(np.zeros(0, np.int64),) * 3, run
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_s), run


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) to check; of dense runs a spanning forest, and (a, b) = (member, root) with its tree's number."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        region = table["region"].to_numpy()
        keys = np.frombuffer(b"".join(table["key"].to_pylist()), ">u4").reshape(-1, DEPTH)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        doc, n = table["doc"].to_numpy(), table["n"].to_numpy()
        i, j, s, run = region_pairs(region, keys, n, sketch, percent)
        dense = np.bincount(run[i], minlength=run[-1] + 1) > DENSE * np.bincount(run)
        thick = dense[run[i]]
        a, b, group = [doc[i[~thick]]], [doc[j[~thick]]], [np.zeros((~thick).sum(), np.int64)]
        if thick.any():
            it, jt, st = i[thick], j[thick], s[thick]
            order = np.lexsort((doc[jt], doc[it], -st, run[it]))
            tree, kept = _Union(), []
            for x, y in zip(it[order].tolist(), jt[order].tolist(), strict=True):
                if tree.join(x, y):
                    kept.append((x, y))
            e = np.array(kept).reshape(-1, 2)
            a.append(doc[e[:, 0]])
            b.append(doc[e[:, 1]])
            group.append(np.zeros(len(e), np.int64))
            members = np.unique(e)
            roots = np.array([tree.find(x) for x in members.tolist()])
            name = mix(region[roots].view(np.uint64) * np.uint64(31) + doc[roots].view(np.uint64)).view(np.int64) | 1
            a.append(doc[members])
            b.append(doc[roots])
            group.append(name)
        a, b, g = np.concatenate(a), np.concatenate(b), np.concatenate(group)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(g == 0, np.minimum(a, b), a)), pa.array(np.where(g == 0, np.maximum(a, b), b)), pa.array(g)], ["a", "b", "grp"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(region, region[-1], side="left")) if region[0] <= region[-1] else 0
        if cut or (held and held[-1].column(0)[-1].as_py() != region[-1]):
            held.append(batch.slice(0, cut))
            rows = [x for x in held if x.num_rows]
            if rows:
                yield from work(pa.Table.from_batches(rows))
            held = []
        held.append(batch.slice(cut))
    rows = [x for x in held if x.num_rows]
    if rows:
        yield from work(pa.Table.from_batches(rows))


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a task, CONTRACTED nodes at a time, as edges to the smallest node they reach there."""
    tree = _Union()

    def flush() -> pd.DataFrame:
        out = [(x, tree.find(x)) for x in tree.up]
        tree.up = {}
        return pd.DataFrame([x for x in out if x[0] != x[1]], columns=["a", "b"], dtype="int64")

    for p in parts:
        for a, b in zip(p["a"].tolist(), p["b"].tolist(), strict=True):
            tree.up.setdefault(a, a)
            tree.up.setdefault(b, b)
            tree.join(a, b)
        if len(tree.up) > CONTRACTED:
            yield flush()
    yield flush()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) of every node of undirected edges (a, b): the smallest node it reaches.

    Large-star and small-star steps alternate until nothing changes; each is saved. Only minima are
    gathered for a node, never its neighbours.
    """
    now = tables.save(edges.where("a <> b").mapInPandas(_contract, "a long, b long"), short=True)
    mark = None
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = tables.save(small.where("a <> b").distinct(), short=True)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tables.drop(now)
        now = after
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _prefixes(batches: Iterator[pa.RecordBatch], common, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each set the rarest shingles, so many that two sets at the threshold have one of them in common.

    Any fixed order of shingles will do, a good one makes few pairs. `parts`: how many tasks share a shingle.
    """
    keys, counts, parts = common.value
    for batch in batches:
        lists = batch.column(1)
        begin = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)
        lo, m = 0, len(begin) - 1
        while lo < m:
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + 1_000_000, side="right")) - 1)
            h, n = values[begin[lo] : begin[hi]], np.diff(begin[lo : hi + 1])
            of = np.repeat(np.arange(hi - lo), n)
            if len(keys):
                near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[near] == h
                count, part = np.where(hit, counts[near], 0), np.where(hit, parts[near], 1)
            else:
                count, part = np.zeros(len(h), np.int64), np.ones(len(h), np.int64)
            order = np.lexsort((h, count, of))
            at = np.arange(len(h)) - np.repeat(begin[lo:hi] - begin[lo], n)
            take = at < np.repeat(n - (n * percent + 99) // 100 + 1, n)
            row = of[take]
            side = [batch.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in ("doc", "component", "outside")]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][take]), pa.array(part[order][take]), pa.array(at[take]), pa.array(n[row]), *side], ["item", "parts", "at", "n", "doc", "component", "outside"])
            lo = hi


def _rare_pairs(sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Pairs (a, b) in different components, one `outside`, that may reach the threshold: none that does is missing.

    Shingles are ordered by how many of at most about COUNTED sets hold them. Two sets at the threshold
    share a shingle of their prefixes, and the first shared one leaves enough behind it in both.
    """
    total = max(sets.count(), 1)
    some = sets if total <= COUNTED else sets.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(-(-total // COUNTED))) == 0)
    scale = max(1, -(-total // COUNTED))
    top = some.select(F.explode("items").alias("item")).groupBy("item").count().where("count > 1").orderBy(F.desc("count"), "item").limit(COMMON).toArrow()
    keys, counts = top["item"].to_numpy(), top["count"].to_numpy()
    order = np.argsort(keys)
    common = sets.sparkSession.sparkContext.broadcast((keys[order], counts[order], 1 + counts[order] * scale // SHARE))
    rows = tables.save(sets.mapInArrow(partial(_prefixes, common=common, percent=percent), "item long, parts long, at long, n long, doc long, component long, outside boolean"))
    left = rows.where("outside").select("item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("at").alias("at_a"), F.col("n").alias("n_a"), F.col("doc").alias("a"), F.col("component").alias("of_a"))
    right = rows.select("item", F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"), F.col("at").alias("at_b"), F.col("n").alias("n_b"), F.col("doc").alias("b"), F.col("component").alias("of_b"))
    enough = (100 + percent) * (1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)) >= percent * (F.col("n_a") + F.col("n_b"))
    return left.join(right, ["item", "part"]).where((F.col("of_a") != F.col("of_b")) & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hub_links(outside: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members outside the largest component with hubs of their group; a hub's set is dealt to DEAL parts."""
    part = F.pmod(F.xxhash64("doc"), F.lit(DEAL)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("part")
    pairs = outside.withColumn("part", part).join(hubs.select("grp", "hub", every), ["grp", "part"]).where("doc <> hub").select("doc", "hub", "part").distinct()
    x = sets.select("doc", F.col("items").alias("x"))
    y = sets.select(F.col("doc").alias("hub"), F.col("items").alias("y")).join(hubs.select("hub").distinct(), "hub").select("hub", "y", every)
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.join(x, "doc").join(y, ["hub", "part"]).where(100 * both >= percent * (F.size("x") + F.size("y") - both))
    return near.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))


def _placed(members: DataFrame, comps: DataFrame, tables: Tables) -> DataFrame:
    """Members (grp, doc, component, outside) of groups that are not one component."""
    placed = tables.save(members.join(comps, F.col("doc") == F.col("node"), "left").select("grp", "doc", F.coalesce("component", "doc").alias("component")), short=True)
    sizes = placed.groupBy("grp", "component").count()
    main = sizes.groupBy("grp").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("several")).where("several > 1")
    part = F.pmod(F.xxhash64("doc"), F.lit(DEAL)).cast("int")  # a large group's members are dealt out
    main = main.select("grp", "main", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("part"))
    open_ = placed.withColumn("part", part).join(main, ["grp", "part"]).select("grp", "doc", "component", (F.col("component") != F.col("main")).alias("outside"))
    return tables.save(open_, short=True)


def _rest(members: DataFrame, own: DataFrame, classes: DataFrame, links: DataFrame, comps: DataFrame, words: int, percent: int, tables: Tables) -> DataFrame:
    """Components after all links between members of a group, in whatever number, are found.

    Hubs come first, as they may link most of a crowd; what stays outside a group's largest component is
    then compared with all that shares a rare shingle.
    """
    open_ = _placed(members, comps, tables)
    if open_.isEmpty():
        return comps
    who = open_.groupBy("doc").agg(F.first("component").alias("component"), F.max("outside").alias("outside"))
    sets = _sets_of(tables.save(who.select(F.col("doc").alias("id")), short=True), classes, own, words, tables)

    crowded = open_.groupBy("grp").count().where(F.col("count") > REGION).select("grp")
    both = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("doc")).agg(F.count("*").alias("links"))
    best = open_.join(crowded, "grp", "left_semi").join(both, "doc").groupBy("grp", "component").agg(F.max_by("doc", F.struct("links", -F.col("doc"))).alias("hub"), F.max("links").alias("links"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("links"), "hub"))
    hubs = tables.save(best.withColumn("_rank", rank).where(F.col("_rank") <= HUBS).select("grp", "hub"), short=True)
    if not hubs.isEmpty():
        more = tables.save(_hub_links(open_.where("outside").select("grp", "doc"), hubs, sets, percent).distinct(), short=True)
        if not more.isEmpty():
            links = tables.save(links.union(more), short=True)
            comps = tables.save(components(links, tables), short=True)
            open_ = _placed(members, comps, tables)
            if open_.isEmpty():
                return comps
    who = open_.groupBy("doc").agg(F.first("component").alias("component"), F.max("outside").alias("outside"))
    pairs = tables.save(_rare_pairs(sets.join(who, "doc"), percent, tables), short=True)
    more = tables.save(_checked(pairs, sets, percent))
    return comps if more.isEmpty() else tables.save(components(links.union(more), tables), short=True)


def _marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows with `_may`: false where `key` is surely none of `ids` (its column `id`).

    Ids set bits of a table of 2**24, broadcast as at most 2**18 longs, whatever their number; rows whose
    bit is not set need no shuffle to be told apart.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 24))
    bits = ids.select(place(F.col("id")).alias("at")).groupBy(F.floor(F.col("at") / 64).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("_bits"))
    known = rows.withColumn("_at", place(F.col(key).cast("long"))).withColumn("_word", F.floor(F.col("_at") / 64))
    hit = F.expr("coalesce(_bits & shiftleft(1L, int(_at % 64)), 0L) <> 0")
    return known.join(F.broadcast(bits), "_word", "left").withColumn("_may", hit).drop("_at", "_word", "_bits")


def _sets_of(ids: DataFrame, classes: DataFrame, own: DataFrame, words: int, tables: Tables) -> DataFrame:
    """doc and items, the full set, of the nodes `ids` (column `id`)."""
    want = tables.save(ids.join(classes.select(F.col("node").alias("id"), F.col("rep").alias("doc"), "n", "h1", "h2"), "id"), short=True)
    text = _marked(own, "doc_id", want.select(F.col("doc").alias("id"))).where("_may").select("doc_id", "text")
    made = text.mapInArrow(partial(_full_sets, k=words), "doc long, items array<long>, n long, h1 long, h2 long")
    one = made.join(want, ["doc", "n", "h1", "h2"]).dropDuplicates(["doc", "n", "h1", "h2"])
    return tables.save(one.select(F.col("id").alias("doc"), "items"))


def _linked(docs: DataFrame, words: int, percent: int, tables: Tables) -> DataFrame:
    """doc_id, n, h1 and h2 of every row's set, its component_id, and whether rows of this set and id are the one to stay."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = tables.save(own.mapInArrow(partial(_sign, k=words), "doc_id long, n long, h1 long, h2 long, sig binary"))
    tables.sized(signed.count())
    full = signed.where("n > 0 and doc_id is not null")
    # all rows of a class have one set, and so one signature
    classes = tables.save(full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")))
    # of classes with the same smallest id the first goes by it, the others by numbers of their own
    same = F.struct("n", "h1", "h2")
    shared = tables.save(classes.groupBy("rep").agg(F.count("*").alias("_several"), F.min(same).alias("_first")).where("_several > 1").drop("_several"), short=True)
    plain = shared.isEmpty()
    if plain:
        classes = classes.withColumn("node", F.col("rep"))
    else:
        node = F.when(F.col("_first").isNull() | (F.col("_first") == same), F.col("rep")).otherwise(F.xxhash64("rep", "n", "h1", "h2"))
        classes = tables.save(classes.join(shared, "rep", "left").withColumn("node", node).drop("_first"))
    reps = classes.select(F.col("node").alias("doc_id"), "n", "sig")

    forest = reps.mapInArrow(_trees, "region long, key binary, doc long, n long, sketch binary")
    crowds = tables.save(reps.mapInArrow(_regions, "region long, doc long").groupBy("region").count().where(F.col("count") > min(REGION, HOT)), short=True)
    regions = crowds.where(F.col("count") > HOT)
    if not regions.isEmpty():  # a hot region goes by its full order, and what is alike even there by chance; `_rest` makes up for it
        salt = F.pmod(F.xxhash64("doc", "region"), F.ceil(F.col("count") / HOT))
        forest = forest.join(regions, "region", "left").withColumn("region", F.when(F.col("count").isNull(), F.col("region")).otherwise(F.xxhash64("region", "key", salt))).drop("count")
    forest = forest.repartition(parts, "region").sortWithinPartitions("region", "key", "doc")
    found = tables.save(forest.mapInArrow(partial(_candidates, percent=percent), "a long, b long, grp long"))
    pairs = tables.save(found.where("grp = 0 and a <> b").select("a", "b").distinct(), short=True)

    ids = tables.save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), short=True)
    links = tables.save(_checked(pairs, _sets_of(ids, classes, own, words, tables), percent))
    comps = tables.save(components(links, tables), short=True)

    # groups of which only a forest was checked and regions too large for all pairs: find what is left
    members = found.where("grp <> 0").select("grp", F.col("a").alias("doc"))
    if not crowds.isEmpty():  # a few other regions may be taken with them
        members = members.union(reps.mapInArrow(partial(_regions, crowds=spark.sparkContext.broadcast(_bits(crowds, "region"))), "region long, doc long"))
    comps = _rest(tables.save(members, short=True), own, classes, links, comps, words, percent, tables)

    named = classes.drop("sig").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if plain:
        named = named.select("n", "h1", "h2", F.col("component").alias("component_id"), (F.col("rep") == F.col("component")).alias("stays"))
    else:  # a node is not always an id: each component takes its smallest
        named = tables.save(named, short=True)
        one = F.struct("rep", "n", "h1", "h2")
        named = named.join(named.groupBy("component").agg(F.min(one).alias("_one")), "component").select("n", "h1", "h2", F.col("_one.rep").alias("component_id"), (one == F.col("_one")).alias("stays"))
    known = signed.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return known.select("doc_id", "n", "h1", "h2", component.alias("component_id"), (F.coalesce("stays", F.lit(True)) & F.coalesce(F.col("doc_id") == component, F.lit(True))).alias("stays"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 times the common shingles are at least `percent` times all. A text of
    fewer words is one shingle; empty and null texts have none and link with nothing. A row goes by its own
    text: rows that share a doc_id but not their set are documents of their own. A null doc_id links with
    nothing and is kept. `kept`: the row's id is the smallest of its component.
    """
    found = _linked(docs, words, percent, Tables(docs.sparkSession))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _with_set(batches: Iterator[pa.RecordBatch], k: int, at: int) -> Iterator[pa.RecordBatch]:
    """The rows with the size and the hashes of their sets."""
    for batch in batches:
        for lo, hi, buf, offsets in chunks(batch.column(at), "ascii"):
            n, h1, h2 = _named(*_sets(*shingles(Words(buf, offsets), k)))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(n), pa.array(h1), pa.array(h2)], [*batch.schema.names, "_n", "_h1", "_h2"])


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows, unchanged, of which one stays from each group of near duplicates.

    It is the row with the smallest doc_id; where rows share that id, one whose text is near the group's,
    and of equal sets the smallest text. No text goes that is near to none that stays: rows with the same id
    and other texts are judged apart. Rows without an id or without words all stay. Rows that may go are told by a
    bounded table of bits, so only those are shuffled with their text.
    """
    bound_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    keys = ["_n", "_h1", "_h2"]
    found = _linked(docs, words, percent, tables).where("doc_id is not null and n > 0").groupBy(F.col("doc_id").alias("id"), *(F.col(k[1:]).alias(k) for k in keys))
    odd = tables.save(found.agg(F.first("stays").alias("_stays"), F.count("*").alias("_rows")).where("_rows > 1 or not _stays"), short=True)
    names, own = docs.columns, docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    key, text = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = _marked(own, key, odd.select("id"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", _n long, _h1 long, _h2 long"
    may = rows.where("_may").select(own.columns).mapInArrow(partial(_with_set, k=words, at=docs.columns.index("text")), schema).withColumn("id", F.col(key).cast("long"))
    sifted = may.join(odd, ["id", *keys], "left").where("coalesce(_stays, true)")
    whole = F.struct(*own.columns)
    repeated = sifted.where("_rows > 1").groupBy("id", *keys).agg(F.min_by(whole, F.struct(text, F.to_json(whole))).alias("_row")).select("_row.*")
    single = sifted.where("coalesce(_rows, 1) = 1").select(own.columns)
    return rows.where("not _may").select(own.columns).unionByName(single).unionByName(repeated.select(own.columns)).toDF(*names)
