"""Language of words and documents by a linear-chain conditional random field.

Every word has a label. Its emission is a sum of learned weights of hashed features: the whole word,
its prefixes and suffixes, its byte trigrams, and its membership in learned lexicons of each language's
frequent words. Transitions are learned too, from sequences that switch language. Forward-backward
gives each word's label probabilities; a document's are their mean over words with letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.core import Tables, bound_batches, gathered, held_out, narrow, sample_of_each
from shelfspark.llm.words import Words, chunks, mix

BITS = 16
AFFIXES = (2, 3, 4)
BLOCK = 128
UNKNOWN = "und"
#: Most frequent words of each language in its lexicon; words of a fitting sequence.
LEXICON, SEQUENCE = 400, 48
_TRI = np.random.default_rng(5).integers(1, 2**63, (3, 256), dtype=np.uint64)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2**BITS, labels)
    lexicon: np.ndarray  # (2**BITS,) a number for the languages in whose lexicon the hashed word is
    transitions: np.ndarray  # (labels, labels), logarithms
    start: np.ndarray


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(w: Words, lexicon: np.ndarray) -> list[np.ndarray]:
    """One slot per word of each kind; trigrams are apart, as words differ in how many they have."""
    word = w.hashes()
    known = lexicon[_slot(word)]
    kinds = [word, mix(known + np.uint64(991))]
    for k in AFFIXES:
        kinds += [w.prefixes(k), w.suffixes(k)]
    return [_slot(h) for h in kinds]


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all byte trigrams inside words, and the word each is of."""
    n = np.maximum(w.end - w.start - 2, 0)
    word = np.repeat(np.arange(len(n)), n)
    at = np.repeat(w.start - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
    return _slot(mix(_TRI[0][w.buf[at]] + _TRI[1][w.buf[at + 1]] + _TRI[2][w.buf[at + 2]])), word


def emissions(w: Words, weights: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w.start), weights.shape[1]), np.float32)
    for slots in features(w, lexicon):
        out += weights[slots]
    slots, word = trigrams(w)
    if len(slots):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(weights[slots], first, axis=0)
    return out


def _exp(e: np.ndarray) -> np.ndarray:
    """Potentials, at most 1; none so small that a few products vanish."""
    return np.exp(np.maximum(e - e.max(1, keepdims=True), -60)).astype(np.float64)


def _scale(a: np.ndarray) -> np.ndarray:
    return a / a.sum(-1, keepdims=True)


def messages(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission potentials, forward and backward messages of every word; `first` bounds the sequences.

    Sequences are cut in blocks. Products of the blocks' potentials give exact messages at their ends,
    whatever the length, and then all blocks run side by side.
    """
    k = e.shape[1]
    p, trans = _exp(e), np.exp(transitions - transitions.max())
    n = np.diff(first)
    per = -(-n // BLOCK)
    offset = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(n)), per)
    rank = np.arange(offset[-1]) - offset[doc]
    begin = first[doc] + rank * BLOCK
    size = np.minimum(BLOCK, first[doc + 1] - begin)
    order = np.argsort(-size, kind="stable")  # blocks that still run come first
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    begin, size, doc, rank = begin[order], size[order], doc[order], rank[order]
    live = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks of more than t words
    live = live[live > 0].tolist()

    # through[i, j]: from label i at a block's first word to label j at its last, with all its words' potentials
    through = np.eye(k) * p[begin][:, None, :]
    many = per[doc] > 1
    if many.any():
        at = np.flatnonzero(many)
        chain = through[at]
        for t in range(1, len(live)):
            m = int(np.searchsorted(-size[at], -t, side="left"))
            if not m:
                break
            step = (chain[:m].reshape(-1, k) @ trans).reshape(m, k, k)
            step *= p[begin[at[:m]] + t][:, None, :]
            chain[:m] = step / step.sum((1, 2), keepdims=True) if t % 8 == 0 else step
        through[at] = chain / chain.sum((1, 2), keepdims=True)
    before = np.tile(np.exp(start - start.max()), (len(begin), 1))
    after = np.ones((len(begin), k))
    by_rank = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[by_rank], np.arange(int(rank.max()) + 2))
    for r in range(1, len(cuts) - 1):
        i = by_rank[cuts[r] : cuts[r + 1]]
        j = place[offset[doc[i]] + r - 1]
        before[i] = _scale(np.einsum("ni,nij->nj", before[j], through[j])) @ trans
    for r in range(len(cuts) - 2, 0, -1):
        i = by_rank[cuts[r] : cuts[r + 1]]
        j = place[offset[doc[i]] + r - 1]
        after[j] = _scale(np.einsum("nij,nj->ni", through[i], after[i])) @ trans.T

    forward, backward = np.empty((len(e), k)), np.empty((len(e), k))
    a = before
    for t, m in enumerate(live):
        a = (a if t == 0 else a[:m] @ trans) * p[begin[:m] + t]
        a = _scale(a) if t % 8 == 0 else a
        forward[begin[:m] + t] = a
    b = after
    for t in range(len(live) - 1, -1, -1):
        m, ends = live[t], live[t + 1] if t + 1 < len(live) else 0
        if t + 1 < len(live):
            step = p[begin[:ends] + t + 1] * b[:ends]
            b[:ends] = (_scale(step) if t % 8 == 0 else step) @ trans.T
        backward[begin[:m] + t] = b[:m]
    return p, forward, backward


def posteriors(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word."""
    if not len(e):
        return np.zeros(e.shape)
    _, forward, backward = messages(e, first, transitions, start)
    return _scale(forward * backward)


def _letters(w: Words) -> np.ndarray:
    """Words with a letter: an ASCII one or any byte beyond ASCII."""
    letter = ((w.buf | 32) >= 97) & ((w.buf | 32) <= 122) | (w.buf >= 128)
    c = np.concatenate([[0], np.cumsum(letter)])
    return c[w.end] > c[w.start]


def label_texts(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """A label and the share of word probability it has, for each text."""
    has = pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.labels:
        return labels, scores
    for lo, hi, buf, offsets in chunks(texts, "utf8"):
        w = Words(buf, offsets)
        post = posteriors(emissions(w, model.weights, model.lexicon), w.first, model.transitions, model.start)
        weight = _letters(w).astype(float)
        share = np.stack([np.bincount(w.doc, post[:, j] * weight, hi - lo) for j in range(post.shape[1])], 1)
        n = np.bincount(w.doc, weight, hi - lo)
        best = share.argmax(1)
        for i in np.flatnonzero(has[lo:hi] & (n > 0)):
            labels[lo + i], scores[lo + i] = model.labels[best[i]], min(1.0, share[i, best[i]] / n[i])
    return labels, scores


def lexicon_table(words: dict[str, list[str]]) -> np.ndarray:
    """For each slot a number that stands for the languages whose words have it, of any count of languages."""
    out = np.zeros(1 << BITS, np.uint64)
    for y, lang in enumerate(sorted(words)):
        for _, _, buf, offsets in chunks(pa.array([" ".join(words[lang])]), None, 1 << 30):
            at = np.unique(_slot(Words(buf, offsets).hashes()))
            out[at] += mix(np.full(1, y + 1, np.uint64))
    return out


def fit(runs: dict[str, list[list[str]]], lexicon: np.ndarray, sequences: int = 3000, rounds: int = 40, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> Model:
    """Weights that raise the likelihood of labelled sequences, each made of one to three stretches of one language.

    `runs`: for each language, lower-cased words in a row from its texts.
    """
    labels = sorted(x for x in runs if any(runs[x]))
    k = len(labels)
    if not k:
        return Model([], np.zeros((1 << BITS, 0), np.float32), lexicon, np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    usable = [[r for r in runs[x] if r] for x in labels]
    made, gold = [], []
    for _ in range(sequences):
        row: list[str] = []
        ys: list[int] = []
        cuts = sorted(rng.integers(6, SEQUENCE - 6, int(rng.integers(0, 3))).tolist())
        for size in np.diff([0, *cuts, SEQUENCE]):
            y = int(rng.integers(k))
            left = int(size)
            while left > 0:
                ws = usable[y][int(rng.integers(len(usable[y])))]
                s = int(rng.integers(max(1, len(ws) - left + 1)))
                got = ws[s : s + left]
                row += got
                ys += [y] * len(got)
                left -= len(got)
        made.append(" ".join(row))
        gold.append(ys)
    parts = []
    for _, _, buf, offsets in chunks(pa.array(made), None, 1 << 30):
        w = Words(buf, offsets)
        slots, word = trigrams(w)
        parts = [*(features(w, lexicon)), slots]
    single, tri, tri_word = np.stack(parts[:-1]), parts[-1], word
    y = np.concatenate([np.array(g) for g in gold])
    n, t_len = len(gold), SEQUENCE
    first = np.arange(n + 1) * t_len
    truth = np.zeros((len(y), k))
    truth[np.arange(len(y)), y] = 1
    pairs = np.zeros((k, k))
    ym = y.reshape(n, t_len)
    np.add.at(pairs, (ym[:, :-1].ravel(), ym[:, 1:].ravel()), 1)
    weights, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    sq_w, sq_t = np.full((1 << BITS, k), 1e-6), np.full((k, k), 1e-6)
    start = np.zeros(k)
    bounds = np.flatnonzero(np.concatenate([[True], tri_word[1:] != tri_word[:-1]])) if len(tri) else np.zeros(0, np.int64)
    for _ in range(rounds):
        e = np.zeros((len(y), k))
        for s in single:
            e += weights[s]
        if len(tri):
            e[tri_word[bounds]] += np.add.reduceat(weights[tri], bounds, axis=0)
        p, forward, backward = messages(e, first, trans, start)
        post = _scale(forward * backward)
        gap = truth - post
        grad = np.stack([sum(np.bincount(s, gap[:, j], 1 << BITS) for s in single) + np.bincount(tri, gap[tri_word, j], 1 << BITS) for j in range(k)], 1) / n
        grad -= decay * weights
        sq_w += grad**2
        weights += rate * grad / np.sqrt(sq_w)
        # expected transitions
        right = (p * backward).reshape(n, t_len, k)[:, 1:]
        left, right, step = forward.reshape(n, t_len, k)[:, :-1].reshape(-1, k), right.reshape(-1, k), np.exp(trans)
        joint = step * (left.T @ (right / ((left @ step) * right).sum(1, keepdims=True)))
        g = (pairs - joint) / n - decay * trans
        sq_t += g**2
        trans += rate * g / np.sqrt(sq_t)
    return Model(labels, weights.astype(np.float32), lexicon, trans, start)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each whole text as stretches of SEQUENCE words, and its distinct words."""
    for batch in batches:
        runs, words = [], []
        for text in batch.column(2).to_pylist():
            ws = text.lower().split()
            runs.append([" ".join(ws[i : i + SEQUENCE]) for i in range(0, len(ws), SEQUENCE)])
            words.append(sorted(set(ws)))
        size = pa.array([sum(map(len, r)) for r in runs], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array(runs, pa.list_(pa.string())), pa.array(words, pa.list_(pa.string()))], ["doc_id", "lang", "size", "runs", "words"])


def train(docs: DataFrame, per_language: int = 300, most_bytes: int = 48 << 20, **how) -> Model:
    """Fits on at most `per_language` labelled rows of each language that are not held out: a fixed bound.

    One narrow pass draws the rows of all languages and one reads their texts. The executors send
    stretches of words, of all rows `most_bytes` together, and each language's frequent words. Texts without
    letters and null languages do not count.
    """
    tables = Tables(docs.sparkSession)
    own = narrow(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    ids = F.broadcast(tables.save(sample_of_each(own.where(~held_out()), "doc_id", "lang", per_language).distinct(), short=True))  # at most `per_language` ids a language
    drawn = own.where(F.col("text").rlike(r"\p{L}")).join(ids, ["doc_id", "lang"]).select("doc_id", "lang", "text")
    made = tables.save(drawn.mapInArrow(_runs, "doc_id long, lang string, size long, runs array<string>, words array<string>"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    often = made.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count().where("count > 1")
    words: dict[str, list[str]] = {}
    for lang, word in often.withColumn("_rank", rank).where(F.col("_rank") <= LEXICON).select("lang", "word").collect():  # at most LEXICON a language
        words.setdefault(lang, []).append(word)
    runs: dict[str, list[list[str]]] = {}
    for row in gathered(made.select("doc_id", "lang", "size", "runs"), "size", most_bytes).to_pylist():
        runs.setdefault(row["lang"], []).extend(r.split(" ") for r in row["runs"])
    return fit(runs, lexicon_table(words), **how)


def _apply(batches: Iterator[pa.RecordBatch], model, at: int, keep: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, scores = label_texts(batch.column(at), model.value)
        if keep is None:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels), pa.array(scores)], [*batch.schema.names, "lang_pred", "lang_score"])
        else:
            yield batch.filter(pa.array([x != UNKNOWN and s >= keep for x, s in zip(labels, scores, strict=True)], pa.bool_()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and lang_score of every row; `und` and 0 for a null text or one without letters.

    Only the text is read: lang, source and doc_id are no inputs. Repeated rows get the same answer; of
    languages with equal shares the first by name counts.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(lambda it: (b.select(["doc_id", "lang_pred", "lang_score"]) for b in _apply(it, sent, 1, None)), "doc_id long, lang_pred string, lang_score double")


def _labelled(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        for lo, hi, buf, offsets in chunks(batch.column(1), "utf8"):
            w = Words(buf, offsets)
            post = posteriors(emissions(w, m.weights, m.lexicon), w.first, m.transitions, m.start) if m.labels else np.zeros((len(w.start), 1))
            best, letters, raw = post.argmax(1), _letters(w), buf.tobytes()
            words = pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)], pa.string())
            known = letters if m.labels else np.zeros(len(letters), bool)
            labels = pa.array([m.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
            scores = pa.array(np.where(known, post[np.arange(len(best)), best], 0.0))
            rows = pa.StructArray.from_arrays([words, labels, scores], ["word", "lang", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), rows)], ["doc_id", "words"])


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the lower-cased words of every row, each with the language it is most likely in and how likely.

    Words without a letter are `und` with 0, as all are where nothing was learned; of languages that are
    equally likely the first by name counts. A null or empty text has no words.
    """
    own = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(lambda it: _labelled(it, sent), "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, unchanged, whose language is known and has at least the share `least` of the words."""
    bound_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return docs.mapInArrow(lambda it: _apply(it, sent, at, least), docs.schema)
