"""Homomorphic fingerprints of texts: wide vectors of their paragraphs, summed modulo powers of two.

A paragraph (a line that is not empty) has a vector of two parts. The first are eight words of its SHA-256,
summed modulo 2^32: equal sums mean equal multisets of paragraphs, in whatever order they came, and a
paragraph is put in or taken out by adding or subtracting its vector. The second are 240 components of 0
or 1 for each of its sentences, bits of the sentence's SHA-256, summed modulo 2^30. Read as -1 and 1, such
sums estimate inner products of the texts' counts of sentences, and so how alike two texts are.

All of it is built-in functions on columns; two components share a long, 30 bits apart. No text has 2^30
sentences, as a string has less than 2^31 bytes and a sentence two at least, so no sum runs over.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make one number, the numbers of a digest, their bits.
DIGITS, NUMBERS, BITS = 15, 4, 60
HALF = BITS // 2
#: Modulus of a component, less one, and the pair of lowest bits of both components of a long.
MASK, PAIR = (1 << HALF) - 1, (1 << HALF) | 1
WORDS, WORD = 8, (1 << 32) - 1
COMPONENTS = BITS * NUMBERS
#: What parts sentences inside a paragraph.
SENTENCE = "[.!?] "
#: Most ranges of ids that `with_next` cuts a table into; a bound of the driver's memory, not of rows.
RANGES = 1 << 16


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the fingerprint of a text column: n sentences, `words` (8 longs), `sums` (120 longs of two components).

    A null text is an empty one, whose sums are all zero; empty lines and empty sentences count for nothing.
    """
    digits = lambda hashes, at, n: F.transform(hashes, lambda h: F.conv(F.substring(h, at, n), 16, 10).cast("long"))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda p: p != "")
    sentences = F.flatten(F.transform("_lines", lambda p: F.filter(F.split(p, SENTENCE), lambda s: s != "")))
    hashes = lambda units: F.transform(units, lambda u: F.sha2(u.cast("binary"), 256))
    out = df.withColumn("_lines", lines).withColumns({"_line_hash": hashes("_lines"), "_hash": hashes(sentences)})
    out = out.withColumns(
        {f"_w{i}": digits("_line_hash", 1 + 8 * i, 8) for i in range(WORDS)} | {f"_c{i}": digits("_hash", 1 + DIGITS * i, DIGITS) for i in range(NUMBERS)}
    )
    words = F.array(*(F.expr(f"aggregate(_w{i}, 0L, (a, x) -> (a + x) & {WORD}L)") for i in range(WORDS)))
    sums = F.concat(*(F.expr(f"aggregate(_c{i}, array_repeat(0L, {HALF}), (a, h) -> transform(a, (x, j) -> x + (shiftright(h, j) & {PAIR}L)))") for i in range(NUMBERS)))
    n = F.size("_hash").cast("long")
    made = out.withColumn(name, F.struct(n.alias("n"), words.alias("words"), sums.alias("sums")))
    return made.select(*df.columns, name)


def _by_component(a: Column, b: Column, of) -> Column:
    low, high = of(a.bitwiseAND(F.lit(MASK)), b.bitwiseAND(F.lit(MASK))), of(F.shiftright(a, HALF), F.shiftright(b, HALF))
    return F.shiftleft(high.bitwiseAND(F.lit(MASK)), HALF).bitwiseOR(low.bitwiseAND(F.lit(MASK)))


def _joined(a: Column, b: Column, of) -> Column:
    return F.struct(
        of(a["n"], b["n"]).alias("n"),
        F.zip_with(a["words"], b["words"], lambda x, y: of(x, y).bitwiseAND(F.lit(WORD))).alias("words"),
        F.zip_with(a["sums"], b["sums"], lambda x, y: _by_component(x, y, of)).alias("sums"),
    )


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of a text with the paragraphs of another put in, wherever they go."""
    return _joined(a, b, lambda x, y: x + y)


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of a text with the paragraphs of another, which it has, taken out."""
    return _joined(a, b, lambda x, y: x - y)


def as_text(a: Column) -> Column:
    """All numbers of a fingerprint in hexadecimal, parted by full stops."""
    return F.array_join(F.transform(F.concat(F.array(a["n"]), a["words"], a["sums"]), lambda x: F.lower(F.hex(x))), ".")


def _product(a: Column, b: Column) -> Column:
    """The inner product of two fingerprints' sums, each component read as -1 and 1."""
    number = lambda x: x.cast("double")
    low, high = lambda x: number(x.bitwiseAND(F.lit(MASK))), lambda x: number(F.shiftright(x, HALF))
    centred = lambda of, x, y: (2 * of(x) - number(a["n"])) * (2 * of(y) - number(b["n"]))
    return F.aggregate(F.zip_with(a["sums"], b["sums"], lambda x, y: centred(low, x, y) + centred(high, x, y)), F.lit(0.0), lambda s, x: s + x)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`df` with how alike two fingerprints are, from 0 to 1.

    An estimate of 2 x.y / (x.x + y.y) for the texts' counts x and y of sentences; 1 if and only if all sums
    are equal, as those of two empty texts are; 0 if one text alone is empty.
    """
    x, y = F.col(a), F.col(b)
    out = df.withColumns({"_ab": _product(x, y), "_aa": _product(x, x), "_bb": _product(y, y)})
    near = F.when(F.col("_aa") + F.col("_bb") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 2 * F.col("_ab") / (F.col("_aa") + F.col("_bb"))))
    # texts whose sentences agree but not their lines are not the same
    same = (x["n"] == y["n"]) & (x["words"] == y["words"]) & (x["sums"] == y["sums"])
    below = F.least(near, F.lit(1 - 2.0**-40))
    return out.withColumn(name, F.when(same, 1.0).otherwise(below)).select(*df.columns, name)


def _ranges(docs: DataFrame, rows: int) -> tuple[Column, list[tuple[int, int | None]]]:
    """Which range a row is in, and (range, first id) of those that have rows, in order."""
    wanted = max(1, min(RANGES, math.ceil(docs.count() / rows)))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * wanted)).alias("cuts")).first()["cuts"] if shares else None
    cuts = sorted(set(cuts or []))
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    held = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    upto = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    group = upto(F.transform(held, lambda g: g[0]))
    at = F.when(group == 0, 0).otherwise((group - 1) * step + upto(F.element_at(held, group))) if groups else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(at).cast("int")
    firsts = docs.select(at.alias("range"), "doc_id").groupBy("range").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none"))
    return at, [(r["range"], None if r["none"] else r["first"]) for r in sorted(firsts.collect())]


def with_next(docs: DataFrame, rows: int = 500) -> DataFrame:
    """doc_id, text, fingerprint, next_text and next_fingerprint: each document with the next one by ascending doc_id.

    Null ids come before all others, rows that share an id stand in the order of their texts, and after the
    last row comes the first. A null text is an empty one. Texts are shuffled once, by ranges of ids with
    about `rows` rows (with more than 65,536 ranges, larger ones); the first row of every range is also sent
    to the range before it. Ranges change where rows meet, never what is found.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at, firsts = _ranges(own, rows)
    placed = own.withColumn("_range", at).withColumn("_after", F.lit(False))
    if firsts:
        # by range: its first id, and the range before it (the last, for the first)
        known = {r: (first, firsts[i - 1][0]) for i, (r, first) in enumerate(firsts)}
        most = max(known) + 1
        first = F.from_json(F.lit(json.dumps([known.get(r, (None, 0))[0] for r in range(most)])), "array<bigint>")
        before = F.from_json(F.lit(json.dumps([known.get(r, (None, 0))[1] for r in range(most)])), "array<int>")
        copies = placed.where(F.col("doc_id").eqNullSafe(first[F.col("_range")])).groupBy(before[F.col("_range")].alias("_range")).agg(F.min("text").alias("text"))
        placed = placed.unionByName(copies.select(F.lit(None).cast("long").alias("doc_id"), "text", "_range", F.lit(True).alias("_after")))
    made = with_fingerprint(placed.repartition("_range"), "text", "fingerprint")
    order = Window.partitionBy("_range").orderBy("_after", F.col("doc_id").asc_nulls_first(), "text")
    follows = made.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return follows.where(~F.col("_after")).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """The columns of `op13_fingerprints`: fingerprints of every text and of the text with its last half replaced.

    The last floor(n_chars / 2) code points give way to as many first ones of the next document, or to all of
    it if it is shorter. Other columns take no part; one row for each row of the input.
    """
    at = [docs.columns.index(n) for n in ("doc_id", "text")]
    own = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    pairs = with_next(own.select(*(F.col(f"_{i}").alias(n) for i, n in zip(at, ("doc_id", "text"), strict=True))))
    half = F.expr("CAST(n_chars div 2 AS INT)")
    new = F.concat(F.expr("substring(text, 1, CAST(n_chars - n_chars div 2 AS INT))"), F.substring("next_text", F.lit(1), half))
    out = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", new).select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint")
    out = with_fingerprint(out, "edited", "edited_fingerprint")
    out = with_likeness(with_likeness(out, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
