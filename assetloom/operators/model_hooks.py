"""User models as batched functions over a table of assets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from assetloom.functions.vectors import l2_normalize, tta_average


def embed(df: DataFrame, input_col: str, make_model: Callable[[], Callable], batch_size: int = 32, flipped_col: str | None = None, out_col: str = "embedding", input_shape: list[int] | None = None) -> DataFrame:
    """``df`` with a unit vector from the user's model, loaded once per worker; with ``flipped_col`` the mean of both
    passes, taken before it is normalised. Array inputs need their ``input_shape``."""
    model = predict_batch_udf(make_model, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[input_shape] if input_shape else None)
    # The outputs are columns before they enter array functions, whose lambdas take no Python functions.
    out = df.withColumn("__raw", model(input_col))
    if flipped_col:
        out = out.withColumn("__flipped", model(flipped_col)).withColumn("__raw", tta_average(F.col("__raw"), F.col("__flipped"))).drop("__flipped")
    return out.withColumn(out_col, l2_normalize(F.col("__raw"))).drop("__raw")


Metrics = dict[str, Callable[[], Callable[[list], np.ndarray]]]


def unavailable_metrics(spark: SparkSession, metrics: Metrics) -> DataFrame:
    """(metric, error) of the metrics whose scorer can't be made. They are tried in tasks, where they will run: the driver
    loads no weights and needs none of their libraries."""

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            failed = []
            for name in pdf["metric"].tolist():
                try:
                    metrics[name]()
                except Exception as error:  # whatever a user's model raises
                    failed.append((name, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(failed, columns=["metric", "error"])

    names = spark.createDataFrame([(n,) for n in metrics], "metric string").repartition(max(1, len(metrics)), "metric")
    return names.mapInPandas(attempt, "metric string, error string")


def score_metrics(df: DataFrame, input_col: str, metrics: Metrics, batch_size: int = 16) -> DataFrame:
    """``df`` with one DOUBLE column per metric. ``metrics`` makes a scorer of each; a metric whose scorer can't be made
    is left out (see ``unavailable_metrics``). A batch that fails is scored row by row, and a row that fails gets 0.0."""
    failed = {r.metric for r in unavailable_metrics(df.sparkSession, metrics).collect()}
    able = {name: make for name, make in metrics.items() if name not in failed}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = {name: make() for name, make in able.items()}
        for pdf in batches:
            yield pdf.assign(**{name: _scored(score, list(pdf[input_col]), batch_size) for name, score in scorers.items()})

    return df.mapInPandas(run, StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in able]]))


def _scored(score: Callable[[list], np.ndarray], values: list, batch_size: int) -> np.ndarray:
    out = np.zeros(len(values))
    for a in range(0, len(values), batch_size):
        part = values[a : a + batch_size]
        try:
            out[a : a + len(part)] = score(part)
        except Exception:  # row by row instead
            for k, v in enumerate(part):
                try:
                    out[a + k] = np.asarray(score([v])).ravel()[0]
                except Exception:  # the row keeps 0.0
                    pass
    return out


def pixel_metric(grid: Column, metric: Callable[[np.ndarray], float]) -> Column:
    """A user function of a grid as a column; null grids and failures give 0.0."""

    @F.pandas_udf("double")
    def run(grids: pd.Series) -> pd.Series:
        def one(g) -> float:
            try:
                return 0.0 if g is None else float(metric(np.asarray(g, np.float64)))
            except Exception:
                return 0.0

        return grids.map(one).astype(float)

    return run(grid)
