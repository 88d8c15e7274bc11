"""Slugs that no two products share."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import slugify
from shelfspark.operators.running import running_sum, sum_in_windows

Save = Callable[[DataFrame], DataFrame]


def _numbers(taken: DataFrame, bases: DataFrame) -> DataFrame:
    """The numbers in use of each base: 1 for the base itself, n for base-n."""
    number = F.regexp_extract("slug", r"-([1-9][0-9]{0,8})$", 1)
    stems = taken.where(number != "").select(F.regexp_extract("slug", r"^(.*)-[0-9]+$", 1).alias("base"), number.cast("long").alias("n")).where("n > 1")
    return stems.union(taken.select("slug", F.lit(1).cast("long"))).join(bases, "base", "left_semi").distinct()


def _numbered(left: DataFrame, taken: DataFrame, save: Save, hot: int) -> DataFrame:
    """For each row the free number of its base that its place in the order of arrival gives.

    The i-th number in use, t, has t - i free ones below it, so the k-th free number is k and as many more
    as there are numbers in use with fewer than k below. Two running counts tell, one of places and one of
    numbers in use; where a base has more than `hot` rows and numbers they are made over ranges of rows.
    """
    none = lambda c: F.lit(None).cast(left.schema[c].dataType).alias(c)
    used = _numbers(taken, left.select("base").distinct()).select("base", F.lit(1).alias("used"), F.col("n"), none("arrival"), none("fingerprint"), none("wanted"))
    rows = left.select("base", F.lit(0).alias("used"), F.lit(0).cast("long").alias("n"), "arrival", "fingerprint", "wanted")
    both = used.unionByName(rows)
    large = not both.groupBy("base").agg(F.count("*").alias("size")).where(F.col("size") > hot).isEmpty()
    counted = partial(running_sum, save=save) if large else sum_in_windows
    placed = counted(both, ("base", "used"), ("n", "arrival", "fingerprint"), F.lit(1), "place")
    free = placed.withColumn("at", F.when(F.col("used") == 1, F.col("n") - F.col("place")).otherwise(F.col("place")))
    found = counted(free, ("base",), ("at", "used", "n"), F.col("used"), "below").where("used = 0")
    n = F.col("at") + F.col("below")
    return found.select("fingerprint", "arrival", "wanted", "base", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("slug"))


def resolve(drafts: DataFrame, reserved: DataFrame, save: Save, hot: int = 100_000) -> DataFrame:
    """fingerprint, wanted and slug of every draft (fingerprint, arrival, name, sku, slug), unique by fingerprint.

    The first to arrive keeps the slug it wants unless another product of `reserved` (slug, owner) has it.
    Others get name and SKU, then -2, -3 and so on; a product that already has such a slug keeps it. Clean
    claims go before numbered ones. Numbered slugs that meet a like one of another base go to a next round.
    A base that more than `hot` products want is numbered by many tasks; `save` writes a table and reads it back.
    """
    wanted = F.coalesce(F.nullif("slug", F.lit("")), slugify(F.col("name")))
    base = F.coalesce(F.nullif(slugify(F.concat_ws(" ", "name", "sku")), F.lit("")), wanted)
    claims = drafts.select("fingerprint", "arrival", wanted.alias("wanted"), base.alias("base"))
    held = reserved.select(F.col("slug").alias("held"), "owner").dropDuplicates(["held"])
    first = claims.groupBy(F.col("wanted").alias("_wanted")).agg(F.min(F.struct("arrival", "fingerprint")).alias("_first"))  # no sort of all who want one slug
    known = claims.join(first, F.col("wanted").eqNullSafe(F.col("_wanted"))).join(held, F.col("wanted") == F.col("held"), "left")
    rows = save(known.withColumn("keeps", F.coalesce(F.col("owner") == F.col("fingerprint"), F.struct("arrival", "fingerprint").eqNullSafe(F.col("_first")))).select("fingerprint", "arrival", "wanted", "base", "keeps"))
    done = rows.where("keeps").select("fingerprint", "wanted", F.col("wanted").alias("slug"))

    left = rows.where("not keeps").drop("keeps")
    rest = F.expr("substring(held, length(base) + 1)")
    own = held.join(left, F.col("owner") == F.col("fingerprint")).where(F.startswith("held", F.col("base")) & rest.rlike(r"^(-[0-9]+)?$"))
    own = save(own.groupBy("fingerprint", "wanted").agg(F.min("held").alias("slug")))
    left = save(left.join(own, "fingerprint", "left_anti"))
    done = done.unionByName(own)
    taken = held.select(F.col("held").alias("slug"))
    while not left.isEmpty():
        proposed = _numbered(left, taken.union(done.select("slug")).distinct(), save, hot)
        proposed = save(proposed.withColumn("wins", F.row_number().over(Window.partitionBy("slug").orderBy("arrival", "fingerprint")) == 1))
        done = done.unionByName(proposed.where("wins").select("fingerprint", "wanted", "slug"))
        left = proposed.where("not wins").select("fingerprint", "arrival", "wanted", "base")
    return done
