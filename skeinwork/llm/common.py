"""What the operators of this subpackage share: columns by exact name, tokens, and the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.session import Rounds, remove, shared_dir, table

__all__ = ["Rounds", "Scope", "batches", "content_keys", "local_threads", "lower_ascii", "pick", "remove", "shared_dir", "staged", "table", "texts"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word rules: space and U+0009 to U+000D, what bytes.split() also takes.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, found by exact name, whatever other columns there are.

    Columns that differ in case only, or that have an operator's own names, cannot clash: columns are
    renamed by position first. Of columns with one name the first counts.
    """
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends here, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """The tables that are staged inside a with block, to be deleted when what was made of them is written."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self):
        self.first = len(_STAGED)
        return self

    def __exit__(self, *error):
        self.paths += _STAGED[self.first :]
        del _STAGED[self.first :]

    def clear(self, spark: SparkSession) -> None:
        while self.paths:
            remove(spark, self.paths.pop())


def batches(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """Arrow batches of few rows and bytes: a batch of long documents must fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def content_keys(text) -> list:
    """Two independent 64-bit hashes of a text (null is empty), as columns k1 and k2."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def lower_ascii(col):
    return F.translate(col, UPPER, UPPER.lower())


def texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def local_threads() -> None:
    """One thread for each task: the executor's cores are Spark's to deal out."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
