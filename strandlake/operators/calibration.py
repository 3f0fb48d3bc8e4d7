"""Recalibration of scores: logistic on the logit, and isotonic."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import logit
from .metrics import calibration_error


def platt(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with p_platt: L2 with unit strength over the sum of losses."""
    assemble = VectorAssembler(inputCols=["_z"], outputCol="_v")
    with_z = lambda d: assemble.transform(d.withColumn("_z", logit(F.col("p"))).withColumn("_y", F.col("y").cast("double")))
    n = train.count()
    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1 / max(1, n), elasticNetParam=0.0, standardization=False, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(with_z(train))
    return model.transform(with_z(test)).withColumn("p_platt", vector_to_array("_p")[1]).drop("_z", "_v", "_y", "_p", "_c", "_r")


def isotonic(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with p_isotonic; scores beyond the training range take the nearest value."""
    model = IsotonicRegression(featuresCol="p", labelCol="_y", predictionCol="p_isotonic").fit(train.withColumn("_y", F.col("y").cast("double")))
    return model.transform(test)


def recalibrated(train: DataFrame, test: DataFrame, bins: int = 15) -> DataFrame:
    """method, ece, mce on ``test`` before and after."""
    if train.limit(2).count() < 2:
        raise ValueError("recalibration needs two rows to fit on")
    both = isotonic(train, platt(train, test))
    out = None
    for name, column in (("none", "p"), ("platt", "p_platt"), ("isotonic", "p_isotonic")):
        part = calibration_error(both.select("row_id", "y", F.col(column).alias("p")), bins).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("method", "ece", "mce")
