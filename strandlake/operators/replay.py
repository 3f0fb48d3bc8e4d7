"""Replay: digests of tables that don't depend on the order of rows, what differs between two tables, and records of runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import slices


def text_of(df: DataFrame, column: str, digits: int = 6) -> Column:
    """A value as text that is the same in any engine: whole numbers, strings and flags as they are, other numbers in so many
    digits, the rest as JSON; null apart from any text."""
    kind, c = dict(df.dtypes)[column], F.col(f"`{column}`")
    if kind in ("double", "float"):
        shown = F.when(F.isnan(c), "nan").when(F.abs(c) >= 1e12, c.cast("string")).otherwise(F.floor(c * 10**digits + 0.5).cast("decimal(38,0)").cast("string"))
    elif kind.startswith(("array", "map", "struct")):
        shown = F.to_json(c)
    elif kind == "binary":
        shown = F.hex(c)
    else:
        shown = c.cast("string")
    return F.coalesce(F.concat(F.lit("="), shown), F.lit("-"))


def row_digest(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> Column:
    """60 bits of a digest of the row's columns."""
    text = F.concat_ws("|", *[text_of(df, c, digits) for c in columns or sorted(df.columns)])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def table_digest(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """n, digest: the sum of row digests, so rows' order and how they are dealt don't matter and a repeated row does."""
    rows = df.select(row_digest(df, columns, digits).alias("d"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("d").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """keys, status of rows that aren't the same in both: gone, new, changed (under one key, any number of rows)."""
    columns = sorted(set(before.columns) & set(after.columns))
    side = lambda df, name: df.groupBy(*keys).agg(F.sum(row_digest(df, columns, digits).cast("decimal(38,0)")).alias(name))
    a, b = side(before, "_a"), side(after, "_b")
    met = a.join(b.withColumnsRenamed({k: f"_k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "full")
    status = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return met.select(*[F.coalesce(k, f"_k_{k}").alias(k) for k in keys], status.alias("status")).filter("status is not null")


Step = Callable[..., Mapping[str, DataFrame]]


def run_record(step: Step, inputs: Mapping[str, DataFrame], parameters: Mapping[str, Any], metrics: Sequence[str] = ()) -> tuple[dict[str, Any], Mapping[str, DataFrame]]:
    """Runs ``step(**inputs, **parameters)``, which gives tables by name; the record of the run has the parameters (seeds among
    them), the digests of inputs and outputs, and the values of outputs in ``metrics``, tables of one row."""
    out = step(**inputs, **parameters)
    digest = lambda df: dict(zip(("n", "digest"), table_digest(df).first(), strict=True))
    values = {name: out[name].first().asDict() for name in metrics}
    return {"parameters": dict(parameters), "inputs": {k: digest(v) for k, v in inputs.items()}, "outputs": {k: digest(v) for k, v in out.items()}, "metrics": values}, out


def replayed(record: Mapping[str, Any], step: Step, inputs: Mapping[str, DataFrame], tolerance: float = 1e-6) -> list[str]:
    """Runs the step again with the record's parameters; what differs, as lines. Inputs must be those of the record. Outputs whose digest
    differs are named; metrics are compared value by value, numbers within the tolerance."""
    spark = next(iter(inputs.values())).sparkSession
    again, _ = run_record(step, inputs, record["parameters"], list(record["metrics"]))
    changed = [k for k, v in record["inputs"].items() if again["inputs"].get(k) != v]
    if changed:
        raise ValueError(f"inputs are not those of the record: {', '.join(changed)}")
    problems = [f"{k}: {v['n']} rows, digest {v['digest']}, against {again['outputs'].get(k)}" for k, v in record["outputs"].items() if k not in record["metrics"] and again["outputs"].get(k) != v]
    pair = lambda tree: spark.createDataFrame([(k, None if v is None else float(v)) for k, v in slices.flattened(tree).items() if not isinstance(v, str)] or [("none", 0.0)], "path string, value double")
    for r in slices.metric_diff(pair(record["metrics"]), pair(again["metrics"]), tolerance).orderBy("path").collect():
        problems.append(f"{r['path']}: {r['problem']} ({r['expected']} and {r['actual']})")
    return problems
