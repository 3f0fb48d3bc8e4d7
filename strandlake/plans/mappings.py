"""The driver's tables seen as tracks, scored frames and sweep results, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def track_sql(speed: str, yaw_rate: str) -> str:
    return f"""
ev AS (SELECT user_id, event_id, ts, event_type, {speed} AS speed, {yaw_rate} AS yaw_rate,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS idx FROM events),
hd AS (SELECT *, CAST(idx AS DOUBLE) / 10 AS t, sum(yaw_rate) OVER (PARTITION BY user_id ORDER BY idx) AS heading FROM ev),
track AS (SELECT *, concat('user_', user_id) AS scene_id, CASE WHEN event_type IN ('error', 'signup') THEN 'sim' ELSE 'real' END AS source,
                 sum(speed * cos(heading) * CAST(0.1 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY idx) AS x,
                 sum(speed * sin(heading) * CAST(0.1 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY idx) AS y FROM hd)"""


TRACK_SQL = track_sql("value / 25.0", "(CAST(json_extract_string(props, '$.k') AS BIGINT) - 50) / 100.0")
#: The same events driven in five ways, by user, so that every label occurs.
DRIVE_SQL = track_sql(
    "CASE WHEN user_id % 5 = 0 THEN value / 25.0 ELSE 4 + value / 125.0 END",
    "(CAST(json_extract_string(props, '$.k') AS BIGINT) - 50) / 100.0 * [1.0::DOUBLE, 0.001, 0.4, 0.04, 0.08][user_id % 5 + 1]",
)

SCORED_SQL = """
scored AS (SELECT l.doc_id AS row_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) / (d.n_chars + 2000) AS p, d.source AS cluster, d.lang AS slice
           FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL)"""

TIED_SQL = """
tied AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, floor(l_discount * 100 + 0.5) / 10 AS p, l_suppkey AS cluster, l_linestatus AS slice FROM lineitem)"""

SWEEP_SQL = """
sweep AS (SELECT o_orderpriority AS knob_noise, CAST(o_orderkey % 3 AS BIGINT) * 2 AS knob_latency, CAST(o_orderkey % 2 AS DOUBLE) / 5 AS knob_bias, o_orderstatus AS model,
                 c_mktsegment AS slice_name, CASE WHEN o_orderkey % 4 = 0 THEN 'overall' ELSE 'slice' END AS scope, o_totalprice / 1e6 AS auc
          FROM orders JOIN customer ON o_custkey = c_custkey)"""


def tracks(spark: SparkSession, sf_dir: str, driven: bool = False) -> DataFrame:
    """user_id, idx, t, x, y, heading, speed, yaw_rate, k, source, scene_id, ts: one series a user. ``driven``: as in DRIVE_SQL."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    speed, yaw_rate, way = F.col("value") / 25.0, (k - 50) / 100.0, F.col("user_id") % 5
    if driven:
        speed = F.when(way == 0, speed).otherwise(4 + F.col("value") / 125.0)
        yaw_rate = yaw_rate * F.element_at(F.array(*map(F.lit, (1.0, 0.001, 0.4, 0.04, 0.08))), (way + 1).cast("int"))
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", speed.alias("speed"), yaw_rate.alias("yaw_rate"), k.alias("k"), (F.row_number().over(w).cast("bigint") - 1).alias("idx"))
    run = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("t", F.col("idx").cast("double") / 10).withColumn("heading", F.sum("yaw_rate").over(run))
    ev = ev.withColumns({"x": F.sum(F.col("speed") * F.cos("heading") * 0.1).over(run), "y": F.sum(F.col("speed") * F.sin("heading") * 0.1).over(run)})
    return ev.withColumn("scene_id", F.concat(F.lit("user_"), F.col("user_id").cast("string"))).withColumn("source", F.when(F.col("event_type").isin("error", "signup"), "sim").otherwise("real"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y, p, cluster, slice: quality labels scored by length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang").filter("n_chars is not null")
    rows = table(spark, sf_dir, "labels").filter("quality is not null").join(d, "doc_id")
    return rows.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"), (F.col("n_chars").cast("double") / (F.col("n_chars") + 2000)).alias("p"), F.col("source").alias("cluster"), F.col("lang").alias("slice"))


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, p, cluster, slice: line items with eleven distinct scores."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.floor(F.col("l_discount") * 100 + 0.5) / 10).alias("p"), F.col("l_suppkey").alias("cluster"), F.col("l_linestatus").alias("slice"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    return o.select(F.col("o_orderpriority").alias("knob_noise"), (key % 3 * 2).cast("bigint").alias("knob_latency"), ((key % 2).cast("double") / 5).alias("knob_bias"), F.col("o_orderstatus").alias("model"), F.col("c_mktsegment").alias("slice_name"), F.when(key % 4 == 0, "overall").otherwise("slice").alias("scope"), (F.col("o_totalprice") / 1e6).alias("auc"))
