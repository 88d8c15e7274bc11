"""Ranked text search over product fields: stems, postings with term weights, scores, the best k.

Text is cut into lower-case words, stop words fall out and the rest is stemmed. A posting (stem, id,
weight) is a row of a table that any number of searches use. In a field of n words a stem that comes c
times weighs (0.5 + 0.5 c / n) (2 - 2^(1 - c)), a tenth more if it is the whole field; a row's score is the
sum over its fields and the stems asked for. A row that holds any stem is found, unless it holds a word
that the query shuts out by a minus or lacks a phrase that the query quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import let

FIELDS = ("name", "brand", "sku", "description")
#: Words without a meaning of their own.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _singular(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _mended(w: Column) -> Column:
    """What is left of a word whose -ed or -ing went: an e comes back, a doubled consonant goes."""
    return F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(r"([b-df-hjkmnp-rtv-y])\1$"), _cut(w, 1)).otherwise(w)


def _present(w: Column) -> Column:
    shorter = F.when(w.rlike("[aeiouy].*ed$"), _cut(w, 2)).when(w.rlike("[aeiouy].*ing$"), _cut(w, 3))
    return F.when(w.endswith("eed"), F.when(w.rlike("[aeiouy][^aeiouy]+eed$"), _cut(w, 1)).otherwise(w)).when(shorter.isNotNull(), let(shorter, _mended)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case English word, by the first rules of Porter's: plurals, -ed, -ing, a last y.

    Words of one or two letters and words with other characters than a to z stay as they are.
    """
    last = lambda w: F.when(w.rlike("[aeiouy].*y$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)
    return F.when((F.length(word) <= 2) | word.rlike("[^a-z]"), word).otherwise(let(let(let(word, _singular), _present), last))


def plain_words(text: Column) -> Column:
    """The words of a text as they are, without stop words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(*STOP))


def words(text: Column) -> Column:
    """The stems of a text without stop words, repeated ones as often as they come."""
    return F.transform(plain_words(text), stem)


def postings(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "id", only: str | None = None) -> DataFrame:
    """(stem, key, weight) of every stem of every row, summed over its fields; a field that the table lacks holds nothing.

    With `only`, a text, the postings of its stems alone. A stem but its last letter opens each of its words,
    as the rules cut and change ends only; just such words are stemmed, the others only counted.
    """
    texts = F.array(*(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields if f in rows.columns))
    each = rows.select(key, F.explode(texts).alias("_text")).select(key, "_text", plain_words(F.col("_text")).alias("_own")).select("*", F.size("_own").alias("_n"))
    if only is None:
        each = each.select(key, "_text", "_n", F.transform("_own", stem).alias("_words"))
    else:
        asked = F.array_distinct(words(F.lit(only)))
        opens = lambda w: F.exists(asked, lambda s: F.startswith(w, F.substring(s, F.lit(1), F.length(s) - 1)))
        each = each.select(key, "_text", "_n", F.filter(F.transform(F.filter("_own", opens), stem), lambda w: F.array_contains(asked, w)).alias("_words"))
    # a field is a row, so its counts need no shuffle
    counted = each.select(key, "_text", "_words", "_n", F.explode(F.array_distinct("_words")).alias("stem"))
    counted = counted.withColumn("_c", F.size(F.filter("_words", lambda w: w == F.col("stem"))))
    whole = F.when(F.col("_text") == F.col("stem"), 1.1).otherwise(1.0)
    weight = (0.5 + 0.5 * F.col("_c") / F.col("_n")) * (2 - F.pow(F.lit(2.0), 1 - F.col("_c"))) * whole
    return counted.groupBy("stem", key).agg(F.sum(weight).alias("weight"))


def _parts(query: str) -> tuple[str, list[str], list[str]]:
    """The words asked for (those of phrases too), the words shut out, and the phrases."""
    phrases = re.findall(r'"([^"]+)"', query)
    rest = re.sub(r'"[^"]*"?', " ", query)
    out = re.findall(r"(?:^|\s)-(\S+)", rest)
    return " ".join([*phrases, re.sub(r"(?:^|\s)-\S+", " ", rest)]), out, phrases


def ranked(rows: DataFrame, query: str, fields: tuple[str, ...] = FIELDS, key: str = "id", index: DataFrame | None = None) -> DataFrame:
    """(key, score) of the rows found, scores to nine places. `index` may be the saved `postings` of the rows.

    A query has few stems, so postings are filtered before they are shuffled, by row groups where the index
    is saved in the order of stems. A query without words finds nothing.
    """
    asked, out, phrases = _parts(query)
    own = postings(rows, fields, key, only=" ".join([asked, *out])) if index is None else index
    held = own.where(F.array_contains(words(F.lit(asked)), F.col("stem"))).groupBy(key).agg(F.round(F.sum("weight"), 9).alias("score"))
    if out:
        held = held.join(own.where(F.array_contains(words(F.lit(" ".join(out))), F.col("stem"))).select(key).distinct(), key, "left_anti")
    if phrases:
        texts = F.array(*(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields if f in rows.columns))
        quoted = [F.exists(texts, _holds(p)) for p in phrases]
        fine = rows.select(key, F.forall(F.array(*quoted), lambda x: x).alias("_fine")).where("_fine").select(key)
        held = held.join(fine, key, "left_semi")
    return held


def _holds(phrase: str):
    return lambda text: F.contains(text, F.lit(phrase.lower()))


def top(rows: DataFrame, query: str, k: int = 25, fields: tuple[str, ...] = FIELDS, key: str = "id", index: DataFrame | None = None) -> DataFrame:
    """The k best rows with their score, equal scores by key: a top-k over (key, score), then a join of k rows."""
    best = ranked(rows, query, fields, key, index).orderBy(F.desc("score"), key).limit(k)
    return rows.join(F.broadcast(best), key).orderBy(F.desc("score"), key)  # k rows
