"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed longest first into the open sequence that has room in every one of
them and scores best, by the norm of what would be left or by a weighted dot product.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import Tables, narrow

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Word pieces whose ids a worker remembers; beyond it the memory is emptied, the results stay the same.
REMEMBERED = 100_000
#: Texts that are Python strings at once.
AT_ONCE = 500
_UNEVEN = re.compile(r" (?=\s)")


def byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabulary files write the 256 bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as bytes, by the vocabulary and merge order of a byte-level BPE file.

    Between two non-space characters a single space always begins a new token of the pattern, so texts
    are encoded by such parts and parts remembered. Ids equal those of the `tokenizers` library without
    special tokens added; that library takes some 50 times longer for short parts, so it reads the file,
    encodes the texts that hold the string of an added token, which is one id, and the tests compare with it.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer, char = Tokenizer.from_file(path), byte_chars()
        ranks = {bytes(char[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in char for c in token)}
        for i, added in tokenizer.get_added_tokens_decoder().items():
            if ranks.get(added.content.encode()) == i:
                del ranks[added.content.encode()]
        self.encode = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = sorted(x.content for x in tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.path, self.tokenizer = path, None  # read again for the few texts that need it
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            if text and self.added and self.added.search(text):
                if self.tokenizer is None:
                    from tokenizers import Tokenizer

                    self.tokenizer = Tokenizer.from_file(self.path)
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
                continue
            if not text or _UNEVEN.search(text):
                yield self.ids(text or "")
                continue
            first, *parts = text.split(" ")
            try:
                rest = [known[p] for p in parts]
            except KeyError:
                if len(known) > REMEMBERED:
                    known.clear()
                for p in parts:
                    if p not in known:
                        known[p] = self.ids(" " + p)
                rest = [known[p] for p in parts]
            yield self.ids(first) + b"".join(rest)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, eos: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = Encoder(path), np.array([eos], "<u4").tobytes()
    for whole in batches:
        for s in range(0, whole.num_rows, AT_ONCE):
            yield _cut(whole.slice(s, AT_ONCE), encode, end, capacity, keep_ids)


def _cut(batch: pa.RecordBatch, encode: Encoder, end: bytes, capacity: int, keep_ids: bool) -> pa.RecordBatch:
    out: list[list] = [[], [], [], [], [], []]
    for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
        ids = ids + end
        n = len(ids) // 4
        at, size, k = 0, n % capacity or min(capacity, n), 0
        while at < n:
            part = ids[4 * at : 4 * (at + size)]
            for column, value in zip(out, (doc, k, at, size, zlib.crc32(part), part if keep_ids else None), strict=True):
                column.append(value)
            at, size, k = at + size, capacity, k + 1
    arrays = [pa.array(c, t) for c, t in zip(out[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if keep_ids:
        arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 2048, eos: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every text and its end id; of a longer document, the first piece is the shorter one.

    A null or empty text is the end id alone; a null doc_id stays null. Repeated rows each give their own
    pieces. `keep_ids` adds the ids.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(partial(_pieces, path=tokenizer, eos=eos, capacity=capacity, keep_ids=keep_ids), PIECES + ", ids array<int>" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: int, docs: int, attention: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets for pieces that come longest first.

    Bins with the same residual capacities are alike, so only distinct residuals are scored: `norm` takes
    the smallest weighted norm of what would be left, `dot` the largest weighted dot product of the piece
    and the residual. A piece that fits none opens a bin, even one beyond the other two capacities.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    scale = np.array([capacity, docs, attention], float)
    w = np.array(weights)
    open_: dict[tuple[int, int, int], list[int]] = {}
    keys: list[tuple[int, int, int]] = []
    row: dict[tuple[int, int, int], int] = {}
    states, made = np.zeros((64, 3)), 0
    # Bins opened by pieces of one length are alike: the scored states stay few.
    for i, n in enumerate(lengths.tolist()):
        need = (n, 1, n * n)
        best = None
        if keys:
            state = states[: len(keys)]
            left = state - need
            fits = (left >= 0).all(1)
            if fits.any():
                if rule == "dot":
                    score = -((state / scale) * (np.array(need) / scale)) @ w
                else:
                    score = (left / scale) ** 2 @ w
                best = keys[int(np.where(fits, score, np.inf).argmin())]
        if best is None:
            b, made = made, made + 1
            room = (capacity, docs, int(attention))
        else:
            b, room = heapq.heappop(open_[best]), best
            if not open_[best]:
                del open_[best]
                at, last = row.pop(best), keys.pop()
                if at < len(keys):  # the last state takes the place of this one
                    keys[at], row[last], states[at] = last, at, states[len(keys)]
        bins[i], offsets[i] = b, capacity - room[0]
        left_over = (room[0] - n, room[1] - 1, room[2] - n * n)
        if min(left_over) > 0:
            if left_over not in open_:
                open_[left_over], row[left_over] = [], len(keys)
                if len(keys) == len(states):
                    states = np.concatenate([states, np.zeros_like(states)])
                states[len(keys)] = left_over
                keys.append(left_over)
            heapq.heappush(open_[left_over], b)
    return bins, offsets


def _place(batches: Iterator[pa.RecordBatch], capacity: int, docs: int, attention: float, rule: str, weights: tuple, at_once: int) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal made
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, docs, attention, rule, weights)
        out = table.append_column("sequence_id", pa.array((part << 33) + made + bins)).append_column("offset", pa.array(offsets))
        made += int(bins.max()) + 1
        held.clear()
        yield from out.to_batches()

    n = 0
    for batch in batches:
        while n + batch.num_rows > at_once:
            held.append(batch.slice(0, at_once - n))
            batch = batch.slice(at_once - n)
            yield from flush()
            n = 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    yield from flush()


def pack(pieces: DataFrame, capacity: int = 2048, max_docs: int = 256, max_attention: float = 2048.0**2, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1), at_once: int = 20_000) -> DataFrame:
    """Pieces with the sequence and offset they go to; no sequence is over any of the three capacities.

    Pieces, of which only numbers and not their texts are moved, are saved, dealt by hash and packed in each
    partition, `at_once` pieces at a time, which bounds a task's memory. Such a group leaves about one
    sequence part-filled, so there are no more partitions than groups: however many partitions the session
    asks for, the sequences exceed the fewest possible by one or two in thousands. Sequences are numbered by
    partition. Ties go by length, doc_id, piece. A piece over a capacity by itself is alone in a sequence.
    An empty table gives no rows.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    pieces = Tables(spark).save(pieces)
    groups = pieces.count() // at_once
    dealt = pieces.repartition(max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))), "doc_id", "piece")
    dealt = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(partial(_place, capacity=capacity, docs=max_docs, attention=max_attention, rule=rule, weights=weights, at_once=at_once), schema).select(*names, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from packed pieces that carry `ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.count("*").alias("n_pieces"))
