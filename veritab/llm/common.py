"""Helpers of the operators: sizes, shared folders, tables."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Texts go to Python in Arrow batches of at most that many rows, so that a batch of long texts stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and a bounded number of bytes. Workers on this machine find this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; only where that is unset and Spark runs in one process, as in tests, a folder of this machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = current.get() if current.isDefined() else None
    if not conf:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that they share")
        import tempfile

        conf = f"file://{tempfile.gettempdir()}/veritab-shared"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(conf)
    return conf if ":" in conf.split("/")[0] else f"file://{conf}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    return _kept(df, f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of intermediate tables in the shared one, which goes as a whole once the results that rest on it are written."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, what: str) -> DataFrame:
        return _kept(df, f"{self.folder}/{what}-{uuid.uuid4().hex[:8]}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a column's texts, by one pass over it."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts_for(size: int, each: int, spark: SparkSession) -> int:
    """How many parts to cut an input of that many bytes into: of about `each` bytes, one for each shuffle partition at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
