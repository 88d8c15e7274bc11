"""A folder of drafts as a stream: each batch is merged and upserted into the newest snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.ingest import dedupe
from shelfspark.operators.store import Snapshots, locked, upsert


def merge_batch(store: Snapshots, drafts: DataFrame) -> int:
    """One batch into a new snapshot. The same batch twice changes nothing but the version."""
    one = dedupe(drafts).drop("n_sources", "file", "sheet", "row_index", "score")
    stored = store.read()
    return store.write(locked(one) if stored is None else upsert(locked(stored), one).drop("outcome", "locks_kept"))


def import_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet drafts from `source`; the checkpoint remembers which files were taken."""
    store = Snapshots(spark, target)
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, _: merge_batch(store, batch) if not batch.isEmpty() else None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
