"""Readers and writers: declared Parquet tables, JSON records, and scripts of SQL statements."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet table by its declared schema; Catalyst prunes columns and pushes filters down."""
    return spark.read.schema(schemas.fields(ddl)).parquet(path)


def write(df: DataFrame, path: str, ddl: str | None = None, by: str | None = None) -> None:
    """Replaces a Parquet table. With a schema, columns are put in its order and cast to its types."""
    if ddl:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.fields(ddl)])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_cells(df: DataFrame, path: str, by: Sequence[str] = ("config_id", "model"), ddl: str = schemas.SWEEP_DDL) -> None:
    """Replaces only the cells (values of ``by``) that ``df`` has; others stay. A cell is there whole or not at all: its files are moved
    in when the job commits. So a sweep that broke goes on with ``cells_left``. A frame that reads the same cells must be saved first."""
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.fields(ddl)])
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_cells(spark: SparkSession, path: str, ddl: str = schemas.SWEEP_DDL) -> DataFrame:
    """The table with its columns in order; filters on cells prune folders."""
    kinds = schemas.fields(ddl)
    return spark.read.schema(kinds).parquet(path).select(*kinds.names)


def cells_left(wanted: DataFrame, path: str, by: Sequence[str] = ("config_id", "model"), ddl: str = schemas.SWEEP_DDL) -> DataFrame:
    """Of the wanted cells, those that the table doesn't have; all, if there is no table."""
    spark = wanted.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return wanted
    return wanted.join(read_cells(spark, path, ddl).select(*by).distinct(), list(by), "left_anti")


def write_record(spark: SparkSession, record: Mapping[str, Any], path: str) -> None:
    """One JSON record with sorted keys, by Spark's writer, so any file system will do."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def statements(script: str) -> Iterator[str]:
    """Statements between semicolons, without comment lines; empty ones are skipped."""
    for part in script.split(";"):
        body = "\n".join(line for line in part.splitlines() if not line.lstrip().startswith("--")).strip()
        if body:
            yield body


def sections(script: str, mark: str) -> tuple[list[str], list[str]]:
    """Statements before and after the line that begins with ``mark``."""
    head, found, tail = script.partition(mark)
    return list(statements(head)), list(statements(tail.partition("\n")[2])) if found else []


def run_script(spark: SparkSession, script: list[str]) -> DataFrame | None:
    """Runs statements in order; the last one's rows."""
    out = None
    for s in script:
        out = spark.sql(s)
    return out
