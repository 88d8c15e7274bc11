"""Upserts that keep locked fields, patches, verification, archives and backfills; snapshots in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.config import POLICY, Policy
from shelfspark.operators.catalog import awaiting_verification
from shelfspark.operators.pricing import with_pricing
from shelfspark.operators.quality import severity_of, with_quality

#: Only people set these; an import never does.
OWNED = ("is_verified", "locked_fields", "overrides")
EDITABLE = ("name", "brand", "category", "sku", "currency", "rdp", "rrp", "selling_price", "quantity", "supplier", "is_active", "is_draft", "is_generic", "procurement", "condition", "lifecycle")
DEFAULTS = {"is_verified": "false", "is_active": "true", "is_generic": "false", "is_draft": "false", "lifecycle": "'draft'", "procurement": "'unclassified'", "quantity": "0"}


def upsert(stored: DataFrame, drafts: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Stored rows with the drafts' values where nothing is locked, and new rows with defaults.

    `outcome` tells created, updated, unchanged or kept (no draft); `locks_kept` counts fields a lock held.
    One full outer join on the key; drafts must be unique by it (see ingest.dedupe).
    """
    fields = [c for c in drafts.columns if c != key and c not in OWNED]
    d = drafts.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields), F.lit(True).alias("_draft"))
    both = stored.withColumn("_stored", F.lit(True)).join(d, key, "full_outer")
    locked = lambda c: F.coalesce(F.array_contains("locked_fields", c), F.lit(False)) | (F.lit(c == "lifecycle") & F.coalesce("is_verified", F.lit(False)))
    value = {c: F.when(F.col("_draft").isNull() | (F.col("_stored").isNotNull() & locked(c)), F.col(c)).otherwise(F.col(f"_new_{c}")) for c in fields if c in stored.columns}
    changed = F.greatest(*(F.when(~v.eqNullSafe(F.col(c)), 1).otherwise(0) for c, v in value.items()), F.lit(0)) == 1
    held = sum((F.when(locked(c) & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")), 1).otherwise(0) for c in value), F.lit(0))
    outcome = F.when(F.col("_stored").isNull(), "created").when(F.col("_draft").isNull(), "kept").when(changed, "updated").otherwise("unchanged")
    fresh = {c: F.when(F.col("_stored").isNull(), F.coalesce(c, F.expr(x))).otherwise(F.col(c)) for c, x in DEFAULTS.items() if c in stored.columns and c not in value}
    columns = [{**value, **fresh}.get(c, F.when(F.col("_stored").isNull(), F.array().cast("array<string>")).otherwise(F.col(c)) if c == "locked_fields" else F.col(c)).alias(c) for c in stored.columns]
    return both.select(*columns, outcome.alias("outcome"), F.when(F.col("_stored").isNotNull() & F.col("_draft").isNotNull(), held).otherwise(0).cast("long").alias("locks_kept"))


def archive_stale(stored: DataFrame, drafts: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Active rows that no draft names become inactive, unverified and archived."""
    named = drafts.select(key).distinct().withColumn("_named", F.lit(True))
    rows = stored.join(named, key, "left")
    stale = F.col("_named").isNull() & F.col("is_active")
    return rows.withColumns({"archived": stale, "is_active": F.col("is_active") & ~stale, "is_verified": F.col("is_verified") & ~stale, "lifecycle": F.when(stale, "archived").otherwise(F.col("lifecycle"))}).drop("_named")


def _by_field(patches: DataFrame) -> DataFrame:
    """One value for each id and field: of several the last by `seq`, where the patches have it, else the greatest."""
    last = F.max_by("value", "seq") if "seq" in patches.columns else F.max("value")
    return patches.groupBy("id", "field").agg(last.alias("value"))


def patch(stored: DataFrame, patches: DataFrame, lock: bool = True) -> DataFrame:
    """Applies (id, field, value as text) to flat rows, never failing the whole batch; values that do not fit are left out.

    Of several values for a field the one with the greatest `seq` counts.
    """
    per = _by_field(patches).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_p"))
    rows = stored.join(per, "id", "left")
    typed = {f: F.col("_p")[f].try_cast(stored.schema[f].dataType.simpleString()) for f in EDITABLE if f in stored.columns}
    differs = {f: v.isNotNull() & ~v.eqNullSafe(F.col(f)) for f, v in typed.items()}
    changed = F.filter(F.array(*(F.when(c, f) for f, c in differs.items())), lambda x: x.isNotNull())
    locks = F.array_union(F.coalesce("locked_fields", F.array().cast("array<string>")), changed) if lock else F.col("locked_fields")
    was = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("previous"), typed[f].cast("string").alias("next"))) for f, c in differs.items())))
    return rows.select(*(F.when(differs[c], typed[c]).otherwise(F.col(c)).alias(c) if c in differs else (locks.alias(c) if c == "locked_fields" else F.col(c)) for c in stored.columns), changed.alias("changed_fields"), was.alias("changes"))


#: Fields whose change prices a product anew.
PRICING = ("currency", "rdp", "rrp", "selling_price")


def apply_patch(stored: DataFrame, patches: DataFrame, reason: str | None = None, actor: str = "admin", lock: bool = True, policy: Policy = POLICY) -> DataFrame:
    """Patched rows, with margins, issues and scores as they are after it, and the last changes in `overrides`.

    `stored` has a product's columns and may have `overrides`; of them the last `policy.audit_tail` stay.
    """
    text = lambda v: F.lit(v).cast("string")
    done = patch(stored, patches, lock)
    new = F.transform("changes", lambda c: F.struct(c["field"].alias("field"), c["previous"].alias("previous"), c["next"].alias("next"), text(reason).alias("reason"), text(actor).alias("by")))
    old = F.coalesce("overrides", F.array()) if "overrides" in stored.columns else F.array().cast("array<struct<field:string,previous:string,next:string,reason:string,by:string>>")
    every = F.concat(old, new)
    tail = F.slice(every, F.greatest(F.size(every) - policy.audit_tail + 1, F.lit(1)), F.lit(policy.audit_tail))
    return with_quality(with_pricing(done.withColumn("overrides", tail).drop("changes"), policy), policy)


def update_price(stored: DataFrame, patches: DataFrame, **how) -> DataFrame:
    """apply_patch of prices and currency only; other fields are left as they are."""
    return apply_patch(stored, patches.where(F.col("field").isin(*PRICING)), **how)


def remove(stored: DataFrame, ids: DataFrame, hard: bool = False) -> DataFrame:
    """Without the rows whose `id` is named, or, if not `hard`, with them inactive and archived."""
    if hard:
        return stored.join(ids.select("id").distinct(), "id", "left_anti")
    named = stored.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    gone = F.coalesce("_gone", F.lit(False))
    return named.withColumns({"is_active": F.col("is_active") & ~gone, "lifecycle": F.when(gone, "archived").otherwise(F.col("lifecycle"))}).select(*stored.columns)


def patch_outcomes(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """updated, unchanged or failed (unknown id, a field that may not be edited, a value that does not fit) for each id and field."""
    own = [f for f in EDITABLE if f in stored.columns]
    rows = _by_field(patches).join(stored.select("id", *(F.col(f).alias(f"_{f}") for f in own)).withColumn("_known", F.lit(True)), "id", "left")
    outcome = F.when(F.col("_known").isNull() | ~F.col("field").isin(*own), "failed")
    for f in own:
        value = F.col("value").try_cast(stored.schema[f].dataType.simpleString())
        mine = F.col("field") == f
        outcome = outcome.when(mine & value.isNull(), "failed").when(mine & value.eqNullSafe(F.col(f"_{f}")), "unchanged")
    return rows.select("id", "field", outcome.otherwise("updated").alias("outcome"))


def create(stored: DataFrame, new: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The stored rows and the new ones whose key is not stored yet, every field given locked; `outcome` also tells conflicts.

    Of new rows with one key the first by `seq`, or else the first as they come, is created. Conflicting rows
    come back with their own values and the outcome conflict, and are not to be written.
    """
    at = F.col("seq") if "seq" in new.columns else F.monotonically_increasing_id()
    new = new.withColumn("_at", at)
    first = new.groupBy(key).agg(F.min("_at").alias("_first"))
    given = [c for c in EDITABLE if c in new.columns and c in stored.columns]
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    locks = F.filter(F.array(*(F.when(F.col(c).isNotNull(), c) for c in given)), lambda x: x.isNotNull())
    fill = {c: F.coalesce(c, F.expr(DEFAULTS[c])) if c in DEFAULTS else F.col(c) for c in new.columns}
    made = {**fill, **{c: F.expr(x) for c, x in DEFAULTS.items() if c not in new.columns}, "locked_fields": locks}
    rows = new.join(known, key, "left").join(first, key, "left").select(*(made.get(c, F.lit(None)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns), F.when(F.col("_known").isNull() & (F.col("_at") == F.col("_first")), "created").otherwise("conflict").alias("outcome"))
    return stored.withColumn("outcome", F.lit("kept")).unionByName(rows)


def unlock(stored: DataFrame, names: list[str]) -> DataFrame:
    gone = F.array(*(F.lit(n) for n in names))
    return stored.withColumns({"unlocked": F.array_intersect("locked_fields", gone), "locked_fields": F.array_except("locked_fields", gone)})


def verify(scored: DataFrame, waived: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """Verifies rows without a critical issue but those waived; the others go to review.

    `verified_by` names who did, `waived` the critical codes of a verified row that were waived.
    """
    critical = F.filter("issues", lambda c: severity_of(c) == "critical")
    let_go = F.array(*(F.lit(w) for w in waived)).cast("array<string>")
    blocked = F.size(F.array_except(critical, let_go)) > 0
    return scored.withColumns({
        "is_verified": ~blocked, "lifecycle": F.when(blocked, "review").otherwise("approved"), "refused": blocked, "verified_by": F.when(~blocked, F.lit(by).cast("string")),
        "waived": F.when(~blocked, F.array_intersect(critical, let_go)).otherwise(F.array().cast("array<string>")),
    })


def publish_candidates(scored: DataFrame, category: str | None = None, with_image: bool = False, waived: tuple[str, ...] = ()) -> DataFrame:
    rows = scored.where(awaiting_verification())
    rows = rows.where(F.col("category") == category) if category else rows
    rows = rows.where("has_image") if with_image else rows
    return verify(rows, waived).select("id", "name", "category", F.when(F.col("refused"), "blocked").otherwise("ready").alias("state"), "issues")


def blocked_by_issue(scored: DataFrame) -> DataFrame:
    codes = publish_candidates(scored).where("state = 'blocked'").select(F.explode("issues").alias("code"))
    return codes.where(severity_of(F.col("code")) == "critical").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def backfill(stored: DataFrame, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    return stored.withColumns({c: F.coalesce(c, F.expr(x)) for c, x in defaults.items() if c in stored.columns})


def backfill_counts(stored: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """How many rows miss each field, in one pass."""
    one = stored.agg(*(F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in fields))
    return one.select(F.explode(F.map_from_arrays(F.array(*(F.lit(f) for f in fields)), F.array(*(F.col(f) for f in fields)))).alias("field", "missing"))


def import_run(spark: SparkSession, source: str, result: DataFrame) -> DataFrame:
    """The audit row of an upsert."""
    n = lambda o: F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o)
    return result.agg(F.lit(source).alias("source"), F.count("*").alias("rows"), n("created"), n("updated"), n("unchanged"), n("kept"), F.sum("locks_kept").alias("locks_kept"))


class Snapshots:
    """Versions of a table in one folder: a version is written whole, and the newest complete one is read."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 5):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(keep, 2)  # one may still be read

    def versions(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [f.getPath() for f in fs.listStatus(where)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, df: DataFrame) -> int:
        """Writes the next version; if another writer has begun it, this fails and nothing is lost. The oldest beyond `keep` go."""
        found = self.versions()
        version = (found or [0])[-1] + 1
        df.write.mode("errorifexists").parquet(f"{self.path}/v{version}")
        for old in found[: max(0, len(found) + 1 - self.keep)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return version


def locked(stored: DataFrame) -> DataFrame:
    """Adds the columns that an import needs, where a table has none."""
    return stored if "locked_fields" in stored.columns else stored.withColumn("locked_fields", F.array().cast("array<string>"))
