"""Small helpers of the text operators: shared storage, table access, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Unset is accepted on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="strandlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Parquet tables in the shared folder that cut lineage. drop() removes a table that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.path, conf = spark._jvm.org.apache.hadoop.fs.Path(self.base), spark._jsc.hadoopConfiguration()
        self.path.getFileSystem(conf).deleteOnExit(self.path)  # what a result still reads goes when the driver ends

    def save(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """The table read again; ``files``: at most so many tasks and files, for rows whose number is known."""
        self.made += 1
        path = f"{self.base}/t{self.made:03d}"
        (df.coalesce(files) if files else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """Saves a result and drops all tables before it."""
        before, self.base = self.base, f"{self.base}-result"
        self.path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = self.path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.deleteOnExit(self.path)
        out = self.save(df)
        files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(before), True)
        return out

    def clear(self) -> None:
        self.path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(self.path, True)

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores after it until no frame has such a column (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[list[list]]:
    """Columns as Python lists, a few rows at a time, so that a batch of long texts is never held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [part.column(i).to_pylist() for i in range(part.num_columns)]


def values_of(array: pa.Array, step: int = 512) -> Iterator[list]:
    """The same for one column."""
    for at in range(0, len(array), step):
        yield array.slice(at, step).to_pylist()


_KEPT: dict[str, object] = {}


def kept(name: str, key: object, make: Callable[[], T]) -> T:
    """An object that later tasks of the same Python worker use again. A worker holds one: another name or key drops it."""
    if _KEPT.get("of") != (name, key):
        _KEPT.clear()
        _KEPT.update(of=(name, key), is_=make())
    return _KEPT["is_"]  # type: ignore[return-value]
