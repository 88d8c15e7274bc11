"""What the operators share: input columns, scratch tables, held-out rows and bounded samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to be no larger than this.
BROADCAST_BYTES = 64 << 20
#: Bytes of one Arrow batch to Python: texts are of any length, so rows are no bound on memory.
BATCH_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows that a Parquet reader holds at once: 4,096 texts or sets are arrays of tens of MB, made anew for each batch.
READ_ROWS, DEFAULT_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "4096"
#: Short rows that one file of a saved table takes.
FILE_ROWS = 100_000


def bound_batches(spark: SparkSession, most: str = "1m", rows: str = "256") -> None:
    """Lowers the session's Arrow batches to `most` bytes, or a row that is longer, and Parquet reads to `rows`, where the session has only Spark's own bounds."""
    for name, own, new in ((BATCH_BYTES, DEFAULT_BYTES, most), (READ_ROWS, DEFAULT_ROWS, rows)):
        # asked for with a default, an entry that is not set is that default and not Spark's own
        if spark.conf.get(name, None) in (None, own) and spark.sparkContext.getConf().get(name) is None:
            spark.conf.set(name, new)


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra ones, even those that differ in case only, do not get in the way."""
    bound_batches(df.sparkSession)
    at = [df.columns.index(n) for n in names]
    own = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return own.select(*(F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="shelfspark-"))
    return _LOCAL[0]


#: The folder of local mode, once made.
_LOCAL: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the process
        pass


class Tables:
    """Written tables in the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/shelfspark-{uuid.uuid4().hex}"
        self.n, self.files = 0, spark.sparkContext.defaultParallelism
        atexit.register(_remove, spark, self.top)

    def sized(self, rows: int) -> None:
        """Tables of short rows get a file for each FILE_ROWS of an input of `rows`, or one for each core."""
        self.files = max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))

    def save(self, df: DataFrame, short: bool = False) -> DataFrame:
        """The same rows, written once; what is read from it depends on no earlier stage.

        `short`: the rows are a few numbers each, so partitions are taken together to at most `files`. On a local disk
        without Hadoop's native library an executor forks three processes for each file that it writes.
        """
        self.n += 1
        path = f"{self.top}/{self.n}"
        (df.coalesce(self.files) if short else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Frees a table that no later result reads."""
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if self.top.rsplit("/", 1)[-1] in path:
                _remove(self.spark, path)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the quarter of rows that no model learns labels from; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def spread(*keys: str) -> Column:
    """A fixed order of rows that tells nothing of them."""
    return F.xxhash64(*keys, F.lit(17))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, chosen by a hash of their key: a fixed bound for what a model is fitted on.

    Keys are counted first, so that only about that many whole rows are sorted.
    """
    n = df.where(F.col(key).isNotNull()).count()
    at = F.pmod(spread(key), F.lit(1 << 30))
    cut = min(1.0, 1.3 * most / max(n, 1) + 50 / max(n, 1))
    return df.where(F.col(key).isNotNull() & (at < int(cut * (1 << 30)))).orderBy(at, key).limit(most)


def sample_of_each(df: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """(key, by) of at most `most` rows for each value of `by`, which has few values, as grades or languages.

    Values are counted first, so that of a frequent one only about that many rows are shuffled and sorted.
    """
    own = df.where(F.col(key).isNotNull() & F.col(by).isNotNull()).select(key, by)
    counts = F.broadcast(own.groupBy(by).agg(F.count("*").alias("_n")))  # a row a value
    near = own.join(counts, by).where(F.pmod(spread(key), F.lit(1 << 30)) < (1.3 * most + 50) / F.col("_n") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod(spread(key), F.lit(1 << 30)), key))
    return near.select(key, by).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def gathered(features: DataFrame, size: str, most: int) -> pa.Table:
    """Rows of a bounded sample, taken in the order of `spread(doc_id)` while their `size` sums up to `most`.

    A row too large for what is left is passed over, as the order of rows tells nothing of them.

    The features are made on the executors and saved; of them only that bound comes to the driver. Of rows
    that share a doc_id one counts.
    """
    tables = Tables(features.sparkSession)
    one = features.groupBy("doc_id").agg(F.min(F.struct(size, *(c for c in features.columns if c not in ("doc_id", size)))).alias("_row")).select("doc_id", "_row.*")
    kept = tables.save(one.withColumn("_at", spread("doc_id")), short=True)  # a bounded sample
    sizes = kept.select("_at", size).orderBy("_at").toArrow()
    taken, left = [], most
    for at, n in zip(sizes["_at"].to_pylist(), sizes[size].to_pylist(), strict=True):
        if n <= left:
            taken.append((at,))
            left -= n
    if len(taken) == sizes.num_rows:
        return kept.orderBy("_at").toArrow()
    return kept.join(F.broadcast(features.sparkSession.createDataFrame(taken, "_at long")), "_at", "left_semi").orderBy("_at").toArrow()
