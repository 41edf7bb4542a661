"""Sessions, staged tables and the sizes that plans are chosen by."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: Rows of numbers in a partition that dealt() makes.
TASK_ROWS = 1 << 19


def build(app: str = "skeinwork", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded_batches(size: int = 32 << 20) -> None:
    """Batches that go to Python workers hold at most about so many bytes, however long their texts or arrays are."""
    if spark := SparkSession.getActiveSession():
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; our own where that is unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skeinwork-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


_STAGED: dict[str, list[str]] = {}


def keep_track(spark: SparkSession, path: str) -> None:
    """clean() deletes this folder too."""
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)


def _write(df: DataFrame, name: str, *sort: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    keep_track(spark, path)
    return path, spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str, *sort: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and readers prune columns and row groups."""
    return _write(df, name, *sort)[1]


class Rounds:
    """Tables of the rounds of one loop: each is staged, and only the last few stay, as a round reads no others."""

    def __init__(self, spark: SparkSession, name: str, keep: int = 1):
        self.spark, self.name, self.keep, self.paths = spark, name, keep, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path, out = _write(df, self.name)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            remove(self.spark, self.paths.pop(0))
        return out


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application staged; what was built on them cannot be read any more."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df (of about so many rows) by keys, in as many partitions as it takes for TASK_ROWS in each: what a task holds does not grow with the table."""
    return df.repartition(parts(df.sparkSession, rows), *keys)


def parts(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def by_ids(rows: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """rows whose number in column is (how: left_semi) or is not (left_anti) among those of ids. Numbers are sent as bitmaps of 64 in a row, so that
    rows stay where they lie up to BROADCAST_ROWS bitmaps, 12.8 M numbers if they are dense; beyond that rows and numbers are shuffled."""
    bits = ids.filter(F.col(column).isNotNull()).groupBy(F.shiftright(column, 6).alias("_block")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")).alias("_bits"))
    bits = staged(bits, "bitmaps")
    few = bits.count() <= BROADCAST_ROWS
    there = F.expr(f"shiftright({column}, 6) = _block AND getbit(_bits, CAST({column} & 63 AS INT)) = 1")
    return rows.join(F.broadcast(bits) if few else bits, there, how)


def numbered(df: DataFrame, name: str, *order, start: int = 0, size: int | None = None) -> DataFrame:
    """df with a column of consecutive numbers along an order. A small table is numbered by one window; a larger one is dealt by
    ranges of the order and written, and each row gets its place in its range plus the sizes of the ranges before. size: df's rows, if known."""
    if (df.limit(BROADCAST_ROWS + 1).count() if size is None else size) <= BROADCAST_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + (start - 1)).cast("long"))
    placed = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_row", row).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + (start - 1)).drop("_part", "_row", "_before")


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """A parameterised statement: names in the text as :name."""
    return spark.sql(sql, args=params)


def scalar(spark: SparkSession, sql: str, default=None, **params):
    """The first column of the first row, default if there is none or it is null."""
    row = query(spark, sql, **params).first()
    return default if row is None or row[0] is None else row[0]
