"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Vectors are cut in short parts and each part is replaced by one of 16 centres. Centres and codes minimise
an anisotropic loss, in which the residual along the vector weighs more than the residual across it, as
only the former moves the inner products that decide a search. A query's inner products with the centres
fill small tables; two neighbouring codes share a byte, so a scan adds one table entry for each pair of
parts. The best by that estimate are ranked again by the exact distance. Squared distance is
|x|^2 - 2 q.x + |q|^2, so a search by distance scans for inner products and adds the exact norms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.core import BROADCAST_BYTES, Tables, bounded_sample, narrow

CENTRES = 16


@dataclass
class Codebook:
    centres: np.ndarray  # (parts, CENTRES, width), float64
    dim: int
    eta: float

    @property
    def parts(self) -> int:
        return len(self.centres)

    def scaled(self, by: float) -> Codebook:
        return Codebook(self.centres * by, self.dim, self.eta)


def _padded(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    out = np.zeros((len(x), parts * width))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def _direction(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def encode(x: np.ndarray, book: Codebook, sweeps: int = 2) -> np.ndarray:
    """Codes (rows, parts) by coordinate descent on |r|^2 + (eta - 1) (r.u)^2, where u is the vector's direction."""
    parts, width = book.parts, book.centres.shape[2]
    v, u = _padded(x, parts, width), _padded(_direction(x), parts, width)
    gap = np.stack([((v[:, p, None, :] - book.centres[p]) ** 2).sum(-1) for p in range(parts)], 1)
    along = np.stack([np.einsum("nkw,nw->nk", v[:, p, None, :] - book.centres[p], u[:, p]) for p in range(parts)], 1)
    code = gap.argmin(2)
    rows = np.arange(len(x))
    total = along[rows[:, None], np.arange(parts), code].sum(1)
    for _ in range(sweeps):
        for p in range(parts):
            rest = total - along[rows, p, code[:, p]]
            new = (gap[:, p] + (book.eta - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(1)
            total = rest + along[rows, p, new]
            code[:, p] = new
    return code


def fit(x: np.ndarray, width: int = 1, threshold: float = 0.2, rounds: int = 8, seed: int = 3) -> Codebook:
    """Centres from a sample: codes and centres in turn lessen the anisotropic loss.

    `threshold` is the cosine from which inner products matter; it sets the weight of the residual along
    the vector, eta = (dim - 1) T^2 / (1 - T^2).
    """
    dim = x.shape[1]
    parts = -(-dim // width)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    v, u = _padded(x, parts, width), _padded(_direction(x), parts, width)
    centres = np.stack([v[rng.choice(len(v), CENTRES, replace=len(v) < CENTRES), p] for p in range(parts)])
    book = Codebook(centres, dim, 1.0)
    for r in range(rounds):
        code = encode(x, book)
        rows = np.arange(len(x))
        for p in range(parts):
            own = book.centres[np.arange(parts), code]
            rest = np.einsum("npw,npw->n", v - own, u) - np.einsum("nw,nw->n", v[:, p] - own[:, p], u[:, p])
            for c in range(CENTRES):
                m = rows[code[:, p] == c]
                if len(m):
                    uu, vv = u[m, p], v[m, p]
                    a = len(m) * np.eye(width) + (book.eta - 1) * uu.T @ uu
                    b = vv.sum(0) + (book.eta - 1) * (uu * (rest[m] + np.einsum("nw,nw->n", vv, uu))[:, None]).sum(0)
                    book.centres[p, c] = np.linalg.solve(a, b)
        book.eta = 1 + (eta - 1) * min(1.0, (r + 1) / 4)
    return book


def pack(code: np.ndarray) -> np.ndarray:
    """Codes of four bits, two to a byte: (rows, ceil(parts / 2))."""
    if code.shape[1] % 2:
        code = np.hstack([code, np.zeros((len(code), 1), code.dtype)])
    return (code[:, 0::2] * CENTRES + code[:, 1::2]).astype(np.uint8)


def _scan(q: np.ndarray, packed: np.ndarray, norms: np.ndarray, book: Codebook) -> np.ndarray:
    """Estimated squared distances less |q|^2, (queries, rows), from byte tables of pairs of four-bit codes.

    Single precision orders them well enough; numbers too large for it are scaled by one factor first.
    """
    parts, width = book.parts, book.centres.shape[2]
    tables = np.einsum("qpw,pkw->pqk", _padded(q, parts, width), book.centres)
    if parts % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:1])])
    most = max(float(norms.max(initial=0)), 2 * len(tables) * float(np.abs(tables).max(initial=0)))
    scale = 1.0 if most < 1e30 else 1e30 / most
    with np.errstate(over="ignore", invalid="ignore"):
        both = ((tables[0::2, :, :, None] + tables[1::2, :, None, :]) * scale).astype(np.float32).reshape(len(tables) // 2, len(q), CENTRES * CENTRES)
        dot = np.zeros((len(q), len(packed)), np.float32)
        for t in range(len(both)):
            dot += np.take(both[t], packed[:, t].astype(np.intp), axis=1)
        return (norms * scale).astype(np.float32) - 2 * dot


def _best(est: np.ndarray, most: int) -> np.ndarray:
    """Columns (queries, most) of each row's smallest estimates, of equal ones those that come first; NaN is smallest."""
    rows, n = est.shape
    if n <= most:
        return np.tile(np.arange(n), (rows, 1))
    est = np.where(np.isnan(est), np.float32(-np.inf), est).astype(np.float32)
    bits = est.view(np.uint32)
    key = np.where(bits >> np.uint32(31) > 0, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    return (np.partition(key, most - 1, axis=1)[:, :most] & np.uint64(0xFFFFFFFF)).astype(np.int64)


class _Nearest:
    """The k nearest rows so far of each of some queries, by distance and then by id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.score = np.full((len(q), k), np.inf)
        self.some = np.zeros((len(q), k), bool)

    def add(self, s: int, e: int, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
        """Rows `at` (queries s..e, candidates) of a block come in, but a query's own."""
        with np.errstate(over="ignore"):
            score = np.sqrt(((x[at] - self.q[s:e, None, :]) ** 2).sum(2))
        some = ids[at] != self.q_ids[s:e, None]
        every = [np.concatenate(c, axis=1) for c in ((self.ids[s:e], ids[at]), (self.score[s:e], score), (self.some[s:e], some))]
        order = np.lexsort((every[0], every[1], ~every[2]), axis=1)[:, : self.k]
        self.ids[s:e], self.score[s:e], self.some[s:e] = (np.take_along_axis(c, order, axis=1) for c in every)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q_ids, self.k)[self.some.ravel()]), pa.array(self.ids[self.some]), pa.array(self.score[self.some])], ["query_id", "vec_id", "score"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding in double precision: no null id, no null, zero or empty vector, no null or non-finite part."""
    own = narrow(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return own.where(F.col("vec_id").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))


def index(vectors: DataFrame, book, dim: int) -> DataFrame:
    """vec_id, embedding, four-bit codes and squared norm of all vectors of `dim` parts; `book` is a broadcast codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    code, norms = pack(encode(x, book.value)), (x**2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norms)], ["vec_id", "embedding", "codes", "norm"])

    return vectors.where(F.size("embedding") == dim).mapInArrow(run, "vec_id long, embedding array<double>, codes binary, norm double")


def _scanned(batches: Iterator[pa.RecordBatch], sent, book, dim: int, k: int, rerank: int, block: int) -> Iterator[pa.RecordBatch]:
    q_ids, q = sent.value
    best = _Nearest(q_ids, q, k)
    for batch in batches:
        for s in range(0, batch.num_rows, block):
            part = batch.slice(s, block)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(part.column(1), dim)[order]
            packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norms = part.column(3).to_numpy(zero_copy_only=False)[order]
            for i in range(0, len(q), 128):
                best.add(i, min(i + 128, len(q)), ids, x, _best(_scan(q[i : i + 128], packed, norms, book.value), rerank))
    yield best.rows()


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = 60, sample: int = 4000, width: int = 1, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score: for each query the k nearest vectors found, but its own.

    The codebook is fitted on at most `sample` vectors of a length; every vector is encoded and scanned, in
    blocks of `block` rows, and in each block `rerank` candidates a query are ranked exactly. Each task
    keeps a query's k nearest and sends them once. Queries go to the executors in lots of a fixed size in
    bytes; with several lots codes are made once and saved. Vectors are near those of their own length
    only. Null, zero and non-finite vectors and null ids take no part; repeated rows are candidates each, while
    queries that share an id are one, the one with the smallest components.
    """
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    base, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("_dim", F.size("embedding"))
    for dim, n in sorted(map(tuple, asked.groupBy("_dim").count().collect())):
        own = base.where(F.size("embedding") == dim)
        drawn = np.array([r[1] for r in bounded_sample(own, "vec_id", sample).collect()])
        with np.errstate(over="ignore", invalid="ignore"):
            book = spark.sparkContext.broadcast(fit(drawn / (np.abs(drawn).max() or 1), width).scaled(np.abs(drawn).max()))
        coded, lots = index(own, book, dim), max(1, -(-n * dim * 8 // BROADCAST_BYTES))
        if lots > 1:
            coded = Tables(spark).save(coded)
        for lot in range(lots):
            rows = asked.where((F.col("_dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(lots)) == lot)).orderBy("vec_id").toArrow()
            if rows.num_rows:
                sent = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), _matrix(rows["embedding"].combine_chunks(), dim)))
                found = found.unionByName(coded.mapInArrow(partial(_scanned, sent=sent, book=book, dim=dim, k=k, rerank=rerank, block=block), found.schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
