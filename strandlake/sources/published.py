"""Publication of tables together: staged, checked, then put in force by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import splits, windows
from . import files

Check = Callable[[Mapping[str, DataFrame]], None]


def whole_segments(tables: Mapping[str, DataFrame]) -> None:
    """Each segment has its 61 rows."""
    bad = windows.incomplete(tables["segments"], ["segment_id"]).limit(1).collect()
    if bad:
        raise ValueError(f"segment {bad[0]['segment_id']} has {bad[0]['n']} rows")


def no_leak(tables: Mapping[str, DataFrame]) -> None:
    """No scene is in two splits."""
    splits.assert_no_leak(tables["labels"], "scene_id")


def same_segments(tables: Mapping[str, DataFrame]) -> None:
    """Labels and features have one row for each segment, and no other."""
    ids = tables["segments"].select("segment_id").distinct()
    for name in ("labels", "features"):
        own = tables[name].select("segment_id")
        if own.groupBy("segment_id").count().filter("count > 1").limit(1).count():
            raise ValueError(f"a segment has two rows in {name}")
        for a, b in ((ids, own), (own, ids)):
            if a.join(b, "segment_id", "left_anti").limit(1).count():
                raise ValueError(f"{name} and segments differ in what segments they have")


DATASET_CHECKS: tuple[Check, ...] = (whole_segments, no_leak, same_segments)


class Published:
    """Versions of a set of tables under one folder. ``current`` names the version in force, in a file that one rename replaces; so readers
    have all tables of one version, and what fails before the rename leaves the version before it in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):  # noqa: ANN202
        return self._path("current").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def publish(self, tables: Mapping[str, DataFrame], checks: Sequence[Check] = DATASET_CHECKS, by: Mapping[str, str] | None = None) -> str:
        """Writes all tables to a new version, checks them as they were written, and puts the version in force. ``by``: a column by table, to
        part its files. A version that fails is removed."""
        version = f"v-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                files.write(df, f"{self.root}/{version}/{name}", by=(by or {}).get(name))
            staged = {name: self.spark.read.schema(df.schema).parquet(f"{self.root}/{version}/{name}").select(*df.columns) for name, df in tables.items()}
            for check in checks:
                check(staged)
        except BaseException:
            self._files().delete(self._path(version), True)
            raise
        record = f"{version}/current"
        out = self._files().create(self._path(record), True)
        out.write(version.encode())
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        replace = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        replace[0] = getattr(jvm, "Options$Rename").OVERWRITE
        jvm.FileContext.getFileContext(self._files().getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(record), self._path("current"), replace)
        return version

    def current(self) -> str | None:
        if not self._files().exists(self._path("current")):
            return None
        return self.spark.read.text(f"{self.root}/current").first()[0]

    def table(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise ValueError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def views(self, names: Sequence[str] = ("segments", "labels", "features")) -> str:
        """Temporary views of the version in force, for SQL."""
        version = self.current()
        for name in names:
            self.spark.read.parquet(f"{self.root}/{version}/{name}").createOrReplaceTempView(name)
        return version

    def drop_others(self) -> None:
        """Removes all versions but the one in force, once no reader has another."""
        keep = {"current", self.current()}
        for x in self._files().listStatus(self._path("")):
            if x.getPath().getName() not in keep:
                self._files().delete(x.getPath(), True)
