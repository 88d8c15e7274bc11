"""Joins by substring: texts that hold any of many patterns, through an inverted index of q-grams.

Patterns of few lengths are joined with the stretches of those lengths. Else a pattern is filed under the one of its q-grams that the fewest texts hold, a pattern of fewer characters
under itself. A text meets the patterns filed under its own grams, and only those are looked for in it.
Texts are compared as they are, each once however often it comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: str, size: int) -> Column:
    """The distinct stretches of `size` characters of a text; none of a shorter one."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def index(patterns: DataFrame, texts: DataFrame, q: int = 4) -> DataFrame:
    """(gram, pattern) of every pattern that may be in a text; `patterns` and `texts` have distinct `pattern` and `text`."""
    long = patterns.where(F.length("pattern") >= q).select("pattern", F.explode(grams("pattern", q)).alias("gram"))
    held = texts.select(F.explode(grams("text", q)).alias("gram")).join(long.select("gram").distinct().hint("merge"), "gram", "left_semi").groupBy("gram").count()
    # a gram that no text holds tells that none holds the pattern, so the inner join loses nothing
    least = long.join(held.hint("merge"), "gram", "left").groupBy("pattern").agg(F.min_by(F.struct("gram", "count"), F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("g"))
    short = patterns.where(F.length("pattern") < q).select(F.col("pattern").alias("gram"), "pattern")
    return least.where("g.count is not null").select("g.gram", "pattern").unionByName(short)


def found(texts: DataFrame, patterns: DataFrame, q: int = 4, lengths: int = 32) -> DataFrame:
    """(text, pattern) of every text and each pattern that it holds, case and marks as they are.

    `texts` has a column `text`, `patterns` a column `pattern`; null and empty ones count for nothing. Patterns of
    at most `lengths` different lengths meet the stretches of those lengths, which are the matches themselves;
    of more lengths they go through the index.
    """
    t = texts.select("text").where("text <> ''").distinct()
    p = patterns.select("pattern").where("pattern <> ''").distinct()
    sizes = sorted(r[0] for r in p.select(F.length("pattern")).distinct().limit(lengths + 1).collect())  # at most lengths + 1 numbers
    short = sizes if len(sizes) <= lengths else [q, *sorted(r[0] for r in p.where(F.length("pattern") < q).select(F.length("pattern")).distinct().collect())]  # less than q numbers
    own = F.array_union(F.concat(*(grams("text", n) for n in short), F.array().cast("array<string>")), F.array().cast("array<string>"))
    # stretches are many more than the size of their texts tells Spark, so none of these joins may broadcast
    if len(sizes) <= lengths:
        return t.select("text", F.explode(own).alias("pattern")).join(p.hint("merge"), "pattern").select("text", "pattern")
    met = t.select("text", F.explode(own).alias("gram")).join(index(p, t, q).hint("merge"), "gram")
    return met.where(F.contains("text", "pattern")).select("text", "pattern").distinct()


def holding(rows: DataFrame, column: str, patterns: DataFrame, pattern: str, q: int = 4, none: bool = False) -> DataFrame:
    """The rows whose text holds any of the patterns, or, with `none`, those whose text holds none (null and empty ones too)."""
    hits = found(rows.select(F.col(column).alias("text")), patterns.select(F.col(pattern).alias("pattern")), q).select(F.col("text").alias("_text")).distinct()
    return rows.join(hits.hint("merge"), F.col(column) == F.col("_text"), "left_anti" if none else "left_semi")
