"""Imports from reading to audit: reports, skipped rows, merged drafts, what is written, and the runs so far."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.config import COMPLETENESS, HEADERS, POLICY, TAXONOMY, Policy
from shelfspark.functions.money import js_round
from shelfspark.functions.specs import count_given
from shelfspark.operators import ingest, store
from shelfspark.operators.pricing import with_pricing
from shelfspark.operators.quality import severity_of, with_quality

#: Skipped rows that a run keeps, that a preview shows, and drafts that it shows.
KEPT, SHOWN, SAMPLES = 500, 100, 10
RUN = "run_id string, source string, status string, error string, sheets long, processed long, rows_read long, rows_data long, rows_skipped long, created long, updated long, unchanged long, archived long, duplicates long, avg_score double, finished_at timestamp, sheet_reports array<struct<sheet:string,rows_read:long,data:long,skipped:string>>, skipped_rows array<struct<sheet:string,row_index:int,reason:string,text:string>>"


def skipped_rows(classified: DataFrame) -> DataFrame:
    """Rows that are no data and not empty, with why; data rows without a name or an SKU are skipped too."""
    return classified.where("kind NOT IN ('data', 'empty', 'header')").select("file", "sheet", "row_index", F.col("kind").alias("reason"), F.array_join(F.array_compact("cells"), " | ").alias("text"))


def totals(report: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return report.agg(F.count("*").alias("sheets"), n(F.col("skipped").isNull().cast("long")).alias("processed"), n("rows_read").alias("rows_read"), n("data").alias("rows_data"), n(F.coalesce("section", F.lit(0)) + F.coalesce("title", F.lit(0)) + F.coalesce("total", F.lit(0))).alias("rows_skipped"))


def draft_quality(scored: DataFrame) -> DataFrame:
    """One row for each code and each severity with how many issues have it, and the mean score of all drafts."""
    mean = scored.agg(js_round(F.sum(F.col("score").cast("decimal(20,4)")).cast("double") / F.nullif(F.count("score"), F.lit(0)), 1).alias("avg_score"))
    codes = scored.select(F.explode("issues").alias("code"))
    by_code = codes.groupBy(F.lit("code").alias("kind"), F.col("code").alias("name")).agg(F.count("*").alias("n"))
    by_severity = by_code.groupBy(F.lit("severity").alias("kind"), severity_of(F.col("name")).alias("name")).agg(F.sum("n").alias("n"))
    return by_code.unionByName(by_severity).join(F.broadcast(mean), how="cross")  # one row


def mapping_confidence(mapping: DataFrame) -> DataFrame:
    """The mean confidence of a sheet's columns that a field was found for."""
    return mapping.where("field IS NOT NULL").groupBy("file", "sheet").agg(F.round(F.avg("confidence"), 3).alias("confidence"))


def merge(scored: DataFrame, score: str = "score", key: str = "fingerprint", policy: Policy = POLICY) -> DataFrame:
    """One draft a key (see ingest.dedupe), with the notes of all and DUPLICATE_PRODUCT; ingest.other_sources has the rows it came from.

    A merged row is another product than any of its rows: it is priced and scored anew.
    """
    merged = ingest.dedupe(scored, score, key)
    more = F.when(F.col("n_sources") > 1, F.array(F.lit("DUPLICATE_PRODUCT"))).otherwise(F.array().cast("array<string>"))
    own = [c for c in merged.columns if c not in _DERIVED]
    return with_quality(with_pricing(merged.select(*own).withColumn("extra_issues", more), policy), policy)


#: Columns that pricing and scoring make, and so make again of merged rows.
_DERIVED = frozenset(
    ("issues", "missing", "completeness", "penalties", "score", "grade", "is_blocked", "extra_issues", "margin", "gross_margin", "margin_value", "band", "fx_rate", "norm_rdp", "norm_rrp", "norm_selling_price")
) | {f"n_{s}" for s in ("critical", "high", "medium", "low", "info")} | {f"earned_{g}" for g in COMPLETENESS}


def complete(drafts: DataFrame) -> DataFrame:
    """Drafts of workbooks with the columns that pricing and scoring read."""
    no, d = F.lit(False), F.coalesce("description", F.lit(""))
    given = {
        "has_specs": count_given(F.col("specs"), F.col("extras")) > 0,
        "quantity": F.coalesce("quantity", F.lit(0)).cast("long"), "has_image": no, "has_description": d != "", "is_verified": no, "is_range": F.coalesce("is_range", no), "condition": F.coalesce("condition", F.lit("unknown")),
    }
    return drafts.withColumns(given)


def parsed(grid: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None, policy: Policy = POLICY) -> DataFrame:
    """Scored drafts of the sheets asked for, before they are merged."""
    return with_quality(with_pricing(complete(ingest.parse(ingest.chosen(grid, only, exclude), policy)), policy), policy)


@dataclass
class Preview:
    """What an import would do, with nothing written."""

    totals: DataFrame
    report: DataFrame
    skipped: DataFrame
    samples: DataFrame
    quality: DataFrame


def preview(grid: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None, policy: Policy = POLICY) -> Preview:
    """Report, the first 100 skipped rows, 10 drafts and the quality of all."""
    own = ingest.chosen(grid, only, exclude)
    report, merged = ingest.sheet_report(own, policy), merge(parsed(own, policy=policy))
    rows = ingest.classify_rows(own.where(ingest.skip_reason(F.col("sheet")).isNull()), ingest.detect_headers(own, policy))
    return Preview(totals(report), report, skipped_rows(rows).orderBy("file", "sheet", "row_index").limit(SHOWN), merged.orderBy(F.desc("score"), "fingerprint").limit(SAMPLES), draft_quality(merged))


def run_row(spark: SparkSession, run_id: str, source: str, counted: DataFrame, outcome: DataFrame, scored: DataFrame, status: str = "completed", error: str | None = None) -> DataFrame:
    """The audit row of a run, of one-row tables: its totals, what was written and the drafts' quality."""
    n = lambda o: F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o)
    wrote = outcome.agg(n("created"), n("updated"), n("unchanged"), F.coalesce(F.sum(F.col("archived").cast("long")), F.lit(0)).alias("archived"))
    of = scored.agg(F.coalesce(F.sum("n_sources") - F.count("*"), F.lit(0)).alias("duplicates"), js_round(F.avg("score"), 1).alias("avg_score"))
    row = counted.join(F.broadcast(wrote), how="cross").join(F.broadcast(of), how="cross")  # one row each
    text = lambda v: F.lit(v).cast("string")
    return row.select(text(run_id).alias("run_id"), text(source).alias("source"), text(status).alias("status"), text(error).alias("error"), *counted.columns, "created", "updated", "unchanged", "archived", "duplicates", "avg_score", F.current_timestamp().alias("finished_at"))


def with_details(row: DataFrame, report: DataFrame, skipped: DataFrame) -> DataFrame:
    """The audit row with what became of each sheet, and the first KEPT rows that were skipped.

    A workbook has a few sheets; of the skipped rows a top-k of fixed size is taken before they are gathered.
    """
    sheets = report.agg(F.array_sort(F.collect_list(F.struct("sheet", F.col("rows_read").cast("long").alias("rows_read"), F.col("data").cast("long").alias("data"), F.col("skipped").cast("string").alias("skipped")))).alias("sheet_reports"))
    first = skipped.orderBy("file", "sheet", "row_index").limit(KEPT).select(F.struct("sheet", "row_index", "reason", "text").alias("r"))
    gone = first.agg(F.array_sort(F.collect_list("r")).alias("skipped_rows"))
    return row.join(F.broadcast(sheets), how="cross").join(F.broadcast(gone), how="cross")  # one row each


def run(spark: SparkSession, run_id: str, source: str, grid: DataFrame, stored: DataFrame, write: Callable[[DataFrame], None], audit: Callable[[DataFrame], None], save: Callable[[DataFrame], DataFrame], archive: bool = False, policy: Policy = POLICY) -> None:
    """Reads, merges, upserts, writes and audits; a failure is audited as failed and raised.

    `save` writes a table and reads it back, so that what is written and what is audited are one result.
    """
    try:
        made = save(merge(parsed(grid, policy=policy), policy=policy))
        done = store.upsert(stored, made.select(*(c for c in made.columns if c in stored.columns)))
        done = save(store.archive_stale(done, made) if archive else done.withColumn("archived", F.lit(False)))
        write(done.drop("outcome", "locks_kept", "archived"))
        report = ingest.sheet_report(grid, policy)
        rows = grid.where(ingest.skip_reason(F.col("sheet")).isNull())
        skipped = skipped_rows(ingest.classify_rows(rows, ingest.detect_headers(rows, policy)))
        audit(with_details(run_row(spark, run_id, source, totals(report), done, made), report, skipped))
    except Exception as e:
        none = spark.createDataFrame([(run_id, source, "failed", str(e)[:500])], "run_id string, source string, status string, error string")
        audit(none.select(*(F.col(f.name) if f.name in none.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], RUN).schema)))
        raise


def runs_page(runs: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    """The runs, the newest first."""
    return runs.orderBy(F.desc("finished_at"), "run_id").offset((max(page, 1) - 1) * limit).limit(limit)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id).limit(1)


def dictionary(spark: SparkSession) -> DataFrame:
    """Every header name that is known, with its field and weight, and the taxonomy."""
    names = [("header", field, name, weight) for field, weight, aliases, _ in HEADERS for name in aliases]
    kinds = [("taxonomy", str(t[0]), " / ".join(str(x) for x in t[1:2]), 0) for t in TAXONOMY]
    return spark.createDataFrame(names + kinds, "kind string, field string, name string, weight int")
