"""Nested products: every leaf of a schema by its dotted path, patches, locks by prefix, and merging leaf by leaf.

A leaf is a field that is no struct; arrays and maps are replaced as a whole. Rules are made per leaf while
the plan is built, so a pass over the rows has one expression a leaf and no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: The paths that an edit may touch.
EDITABLE_PATHS = (
    "name", "brand", "sku", "category", "subcategory", "tags", "alternate_skus", "description.short", "description.long",
    "pricing.currency", "pricing.rdp", "pricing.rrp", "pricing.selling_price", "pricing.market_low", "pricing.market_high", "pricing.price_source",
    "specs.power_wattage", "specs.cable_type", "specs.compatibility", "specs.battery_capacity", "specs.capacity", "specs.interface", "specs.form_factor",
    "specs.length_m", "specs.color", "specs.warranty_months", "specs.condition", "specs.features", "specs.attributes",
    "inventory.quantity", "inventory.supplier", "inventory.alternate_suppliers", "inventory.reorder_point", "inventory.warehouse", "inventory.lead_time_days",
    "status.is_active", "status.is_generic", "status.is_draft", "status.lifecycle", "status.procurement", "images",
)
#: The paths that only people set.
OWNED_PATHS = ("status.is_verified", "metadata.locked_fields", "metadata.overrides")
#: Changes that an edited product remembers.
AUDIT_TAIL = 100


def leaves(schema: StructType, prefix: str = "") -> dict[str, DataType]:
    """Dotted path and type of every leaf, in the schema's order."""
    out: dict[str, DataType] = {}
    for f in schema.fields:
        if isinstance(f.dataType, StructType):
            out |= leaves(f.dataType, f"{prefix}{f.name}.")
        else:
            out[f"{prefix}{f.name}"] = f.dataType
    return out


def at(path: str, of: str | None = None) -> Column:
    """The column of a path, of a struct column `of` if given."""
    return F.col(".".join(f"`{p}`" for p in ([of] if of else []) + path.split(".")))


def rebuilt(schema: StructType, value: Callable[[str], Column], prefix: str = "") -> list[Column]:
    """The columns of a schema with the leaves that `value` gives by path; a struct all of whose leaves are null stays a struct."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        made = F.struct(*rebuilt(f.dataType, value, f"{path}.")) if isinstance(f.dataType, StructType) else value(path)
        out.append(made.alias(f.name))
    return out


def covered(path: str, locks: Column) -> Column:
    """Whether a lock is the path itself or a part of the tree above it; no locks cover nothing."""
    parts = path.split(".")
    above = [".".join(parts[: i + 1]) for i in range(len(parts))]
    return F.coalesce(F.arrays_overlap(locks, F.array(*map(F.lit, above))), F.lit(False))


def is_empty(value: Column, kind: DataType) -> Column:
    """Null, a blank text, an empty list or an empty map."""
    if isinstance(kind, StringType):
        return value.isNull() | (F.trim(value) == "")
    if isinstance(kind, (ArrayType, MapType)):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def fill_missing(schema: StructType, own: str, other: str) -> Column:
    """A struct with the leaves of column `own`, and of `other` where `own` has an empty one."""
    kinds = leaves(schema)
    value = lambda p: F.when(is_empty(at(p, own), kinds[p]) & ~is_empty(at(p, other), kinds[p]), at(p, other)).otherwise(at(p, own))
    return F.struct(*rebuilt(schema, value))


def typed(value: Column, kind: DataType) -> Column:
    """A patch's text as a leaf's type; null if it does not fit. Lists and maps are JSON."""
    if isinstance(kind, StringType):
        return value
    if isinstance(kind, (ArrayType, MapType)):
        return F.from_json(value, kind.simpleString())
    return value.try_cast(kind.simpleString())


def _patched(stored: DataFrame, patches: DataFrame) -> tuple[DataFrame, dict[str, DataType], dict[str, Column]]:
    """Stored rows with the patch of their id as a map by path, the leaves that may be edited, and which of them change."""
    kinds = {p: t for p, t in leaves(stored.schema).items() if p in EDITABLE_PATHS}
    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)
    last = patches.groupBy("id", "path").agg(F.max_by(F.struct("value"), F.struct(seq.alias("s"), F.col("value"))).alias("v"))
    fits = reduce(lambda c, p: c.when(F.col("path") == p, F.col("v.value").isNull() | typed(F.col("v.value"), kinds[p]).isNotNull()), kinds, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    per = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("path", F.col("v.value").alias("value")))).alias("_patch"), F.array_sort(F.collect_list(F.when(~fits, F.col("path")))).alias("_invalid"))
    rows = stored.join(per, "id", "left")
    new = {p: typed(F.col("_patch")[p], t) for p, t in kinds.items()}
    fine = F.coalesce(F.size("_invalid") == 0, F.lit(False))
    differs = {p: fine & F.coalesce(F.map_contains_key("_patch", p), F.lit(False)) & ~_same(new[p], at(p), kinds[p]) for p in kinds}
    return rows, kinds, differs


def _same(a: Column, b: Column, kind: DataType) -> Column:
    return F.to_json(F.struct(a)).eqNullSafe(F.to_json(F.struct(b))) if isinstance(kind, MapType) else a.eqNullSafe(b)


def patch(stored: DataFrame, patches: DataFrame, lock: bool = True, reason: str | None = None, actor: str = "admin") -> DataFrame:
    """Stored nested products after the patches (id, path, value), with the outcome of each row.

    A product's patch with a path that may not be edited, or a value that does not fit, changes nothing of
    it: `outcome` is failed and `invalid` names the paths. Else it is updated, unchanged, or null without a
    patch. Changed paths are locked in `metadata.locked_fields` and told in `metadata.overrides`, of which
    the last AUDIT_TAIL stay, where the product has those. A null value clears a leaf. Of several values for
    a path that with the greatest `seq` counts.
    """
    rows, kinds, differs = _patched(stored, patches)
    text = lambda c: F.to_json(F.struct(c.alias("v")))
    change = F.filter(
        F.array(*(F.when(differs[p], F.struct(F.lit(p).alias("field"), text(at(p)).alias("previous"), text(typed(F.col("_patch")[p], kinds[p])).alias("next"), F.lit(reason).cast("string").alias("reason"), F.lit(actor).alias("by"))) for p in kinds)),
        lambda c: c.isNotNull(),
    )
    rows = rows.withColumn("_changes", change)
    known = leaves(stored.schema)
    names = F.transform("_changes", lambda c: c["field"])

    def value(p: str) -> Column:
        if p == "metadata.locked_fields" and lock:
            return F.array_union(F.coalesce(at(p), F.array().cast("array<string>")), names)
        if p == "metadata.overrides":
            every = F.concat(F.coalesce(at(p), F.array().cast(known[p].simpleString())), F.col("_changes").cast(known[p].simpleString()))
            return F.slice(every, F.greatest(F.size(every) - AUDIT_TAIL + 1, F.lit(1)), F.lit(AUDIT_TAIL))
        return F.when(differs[p], typed(F.col("_patch")[p], kinds[p])).otherwise(at(p)) if p in differs else at(p)

    outcome = F.when(F.col("_patch").isNull(), F.lit(None).cast("string")).when(F.size("_invalid") > 0, "failed").when(F.size("_changes") > 0, "updated").otherwise("unchanged")
    return rows.select(*rebuilt(stored.schema, value), outcome.alias("outcome"), names.alias("changed"), F.col("_invalid").alias("invalid"))


def upsert(stored: DataFrame, drafts: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Stored nested products with every leaf of their draft that no lock covers, and new rows for drafts without one.

    A lock covers its own path and all below it, `pricing` as well as `pricing.rdp`; OWNED_PATHS and the
    lifecycle of a verified product are locked always. Drafts, unique by the key, may lack leaves of the
    stored schema, which then stay; a leaf that is null in a draft becomes null. `outcome` is created,
    updated or kept (no draft), `locks_kept` the number of a draft's leaves that locks held back.
    """
    kinds, given = leaves(stored.schema), leaves(drafts.schema)
    unknown = sorted(set(given) - set(kinds))
    if unknown:
        raise ValueError(f"drafts have leaves that products lack: {', '.join(unknown)}")
    whole = lambda df, name: df.select(F.col(key).alias(f"_{name}_key"), F.struct(*df.columns).alias(name))
    both = whole(stored, "old").join(whole(drafts, "new"), F.col("_old_key") == F.col("_new_key"), "full_outer")
    locks = at("metadata.locked_fields", "old") if "metadata.locked_fields" in kinds else F.array().cast("array<string>")
    verified = F.coalesce(at("status.is_verified", "old"), F.lit(False)) if "status.is_verified" in kinds else F.lit(False)
    known, drafted = F.col("old").isNotNull(), F.col("new").isNotNull()
    held = {p: known & (covered(p, locks) | F.lit(any(p == o or p.startswith(f"{o}.") for o in OWNED_PATHS)) | (F.lit(p == "status.lifecycle") & verified)) for p in given}

    def value(p: str) -> Column:
        if p == key:
            return F.coalesce("_old_key", "_new_key")
        return F.when(drafted & ~held[p], at(p, "new")).otherwise(at(p, "old")) if p in given else at(p, "old")

    kept = reduce(lambda a, b: a + b, (F.when(drafted & held[p], 1).otherwise(0) for p in given if p != key), F.lit(0))
    outcome = F.when(~known, "created").when(drafted, "updated").otherwise("kept")
    return both.select(*rebuilt(stored.schema, value), outcome.alias("outcome"), kept.cast("long").alias("locks_kept"))
