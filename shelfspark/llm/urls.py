"""URL verdicts: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything here is DataFrame and SQL functions and Spark's own tree learner. URLs that a rule fits are
the labelled ones the trees learn from. The shares of blocked urls by host suffix and by first part of the
path are features; for a row that is learned from they are those of other hosts' rows only, so no row sees
its own label or its host's.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.core import bounded_sample, narrow

#: (verdict, host, path): a rule fits its host, all subdomains, and paths that begin with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
FEATURES = (
    "n_chars", "n_host", "n_path", "depth", "n_labels", "digit_share", "host_digit_share", "hyphens", "entropy",
    "n_params", "n_query", "has_fragment", "is_https", "longest_label", "vowel_share", "n_extension", "suffix_rate", "segment_rate",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def apply_rules(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds `rule`, as host and path, and its verdict `ruled`: the longest rule that fits, null if none does."""
    name = lambda host, path: host + path
    best = sorted(rules, key=lambda r: (-len(name(*r[1:])), name(*r[1:])))
    fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)) for _, h, p in best]
    pick = lambda of: reduce(lambda c, x: c.when(x[0], F.lit(of(x[1]))), zip(fits[1:], best[1:], strict=True), F.when(fits[0], F.lit(of(best[0]))))
    return df.withColumns({"rule": pick(lambda r: name(*r[1:])), "ruled": pick(lambda r: r[0])})


def _n_log_n(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of `_url`, host and path that need no other row, `suffix`, the host's last two labels, and `segment`, the path's first part."""
    url, host, path = F.coalesce("_url", F.lit("")), F.col("host"), F.col("path")
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    share = lambda c, pattern: count(c, pattern) / F.greatest(F.length(c), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    # over the sorted characters: the one before, how often it came, and the sum of n log n so far
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1).alias("n"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["sum"] + _n_log_n(a["n"])).alias("sum")))
    size = F.length(url).cast("double")
    entropy = F.aggregate(F.array_sort(F.split(url, "")), start, step, lambda a: F.log2(size) - (a["sum"] + _n_log_n(a["n"])) / size)
    return df.withColumns({
        "n_chars": F.length(url), "n_host": F.length(host), "n_path": F.length(path), "depth": count(path, "/"), "n_labels": F.size(labels),
        "digit_share": share(url, "[0-9]"), "host_digit_share": share(host, "[0-9]"), "hyphens": count(host, "-"), "entropy": F.when(url == "", 0.0).otherwise(entropy),
        "n_params": F.when(query == "", 0).otherwise(1 + count(query, "&")), "n_query": F.length(query), "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "is_https": F.startswith(F.lower(url), F.lit("https:")).cast("int"), "longest_label": F.array_max(F.transform(labels, F.length)),
        "vowel_share": share(host, "[aeiou]"), "n_extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
        "suffix": F.substring_index(host, ".", -2), "segment": F.regexp_extract(path, r"^/([^/]*)", 1),
    })


FOLDS = 5


@dataclass
class Model:
    """Trees, and the shares of blocked urls by suffix and by segment; without rows of both labels the one label, or 0."""

    trees: GBTClassificationModel | None
    rates: dict[str, DataFrame] = field(default_factory=dict)
    constant: float = 0.0


def ruled_pages(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, _url, host, path, rule and ruled of every row."""
    own = narrow(pages, "page_id", "url").select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("_url"))
    host, path = split_url(F.col("_url"))
    return apply_rules(own.withColumns({"host": host, "path": path}), rules)


def _rated(df: DataFrame, rates: dict[str, DataFrame], *more: str) -> DataFrame:
    for part, known in rates.items():  # at most a row a sampled url and fold
        df = df.join(F.broadcast(known), [part, *more], "left").fillna(0.5, [f"{part}_rate"])
    return df


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(df)


def train(ruled: DataFrame, sample: int = 20_000, trees: int = 10, depth: int = 4) -> Model:
    """Trees fitted on at most `sample` of the rows that rules label."""
    labelled = ruled.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    drawn = lexical(bounded_sample(labelled.withColumn("_key", F.xxhash64("page_id", "_url")), "_key", sample)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS))).persist()
    try:
        both = [r[0] for r in drawn.select("label").distinct().collect()]
        if len(both) < 2:
            return Model(None, constant=both[0] if both else 0.0)
        rates, others = {}, {}
        for part in ("suffix", "segment"):
            rate = ((F.sum("blocked") + 1) / (F.sum("n") + 2)).alias(f"{part}_rate")
            sums = drawn.groupBy(part, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
            rates[part] = drawn.sparkSession.createDataFrame(sums.groupBy(part).agg(rate).toArrow(), f"{part} string, {part}_rate double")
            others[part] = sums.join(sums.select(part, F.col("fold").alias("own")), part).where("fold <> own").groupBy(part, F.col("own").alias("fold")).agg(rate)
        rows = _assembled(_rated(drawn, others, "fold")).select("features", "label")
        return Model(GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=32).fit(rows), rates)
    finally:
        drawn.unpersist()


def block_scores(ruled: DataFrame, model: Model) -> DataFrame:
    """The rows with `block_score`, from 0 to 1, by the trees."""
    if model.trees is None:
        return ruled.withColumn("block_score", F.lit(model.constant))
    return model.trees.transform(_assembled(_rated(lexical(ruled), model.rates))).withColumn("block_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, sample: int = 20_000, trees: int = 10, depth: int = 4, at: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row.

    A rule decides where one fits; elsewhere the trees do, fitted on at most `sample` rows that rules
    label. Without rows of both labels the verdict is that of the labelled rows, or allow. Null and odd urls
    have an empty host and path; repeated rows get the same verdict.
    """
    ruled = ruled_pages(pages, rules)
    scored = block_scores(ruled, train(ruled, sample, trees, depth))
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= at, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def held_out_rows(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, **how) -> DataFrame:
    """(ruled, block_score) of the labelled rows of a quarter of the hosts, by trees that saw no row of those hosts."""
    ruled = ruled_pages(pages, rules)
    away = F.crc32("host") % 4 == 2
    return block_scores(ruled.where(away & F.col("ruled").isNotNull()), train(ruled.where(~away), **how)).select("host", "ruled", "block_score")
