"""Sample sizes for an AUC above one half."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf, normal_quantile


def auc_error(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Standard error of Hanley and McNeil; null outside [0, 1]."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    var = (auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)) / (n_pos * n_neg)
    return F.when((auc >= 0) & (auc <= 1), F.sqrt(F.greatest(F.lit(0.0), var)))


def with_power(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds power to rows of (auc, n): half of n positive, the chance to find the AUC above 0.5 at a one-sided level."""
    rows = df.withColumn("_n1", F.floor(F.col("n") / 2).cast("double")).withColumn("_n0", F.col("n") - F.col("_n1"))
    rows = rows.withColumn("_se", auc_error(F.col("auc"), F.col("_n1"), F.col("_n0")))
    rows = rows.withColumn("_z", (F.col("auc") - 0.5) / F.when(F.col("_se") > 0, F.col("_se")) - normal_quantile(1 - alpha))
    return rows.withColumn("power", F.when(F.col("_se") > 0, normal_cdf(F.col("_z"))).otherwise((F.col("auc") > 0.5).cast("double"))).drop("_n1", "_n0", "_se", "_z")


def with_required(df: DataFrame, target: float = 0.8, alpha: float = 0.05, n_max: int = 10_000_000) -> DataFrame:
    """Adds n to rows of auc: the least even number of rows, half of them positive, with enough power to find the AUC above 0.5; null if
    ``n_max`` is too few. In closed form: with m of each class the squared error is (a + (m - 1) d) / m ** 2, so the least m is the
    root of a quadratic."""
    z = normal_quantile(1 - alpha) + normal_quantile(target)
    auc = F.col("auc")
    rows = df.withColumns({"_k": F.when((auc > 0.5) & (auc <= 1), z * z / ((auc - 0.5) * (auc - 0.5))), "_a": auc * (1 - auc), "_d": auc / (2 - auc) + 2 * auc * auc / (1 + auc) - 2 * auc * auc})
    k, a, d, m = F.col("_k"), F.col("_a"), F.col("_d"), F.col("_m")
    rows = rows.withColumn("_m", F.ceil((k * d + F.sqrt(k * k * d * d + 4 * k * (a - d))) / 2))
    enough = lambda x: x * x >= k * (a + (x - 1) * d)
    m = F.greatest(F.when(enough(m - 1), m - 1).when(enough(m), m).otherwise(m + 1), F.lit(2))  # rounding is a step off at most
    return rows.withColumn("_n", F.when(k.isNotNull(), 2 * m).cast("bigint")).withColumn("n", F.when(F.col("_n") <= n_max, F.col("_n"))).drop("_k", "_a", "_d", "_m", "_n")
