"""Smoothing of signals by polynomials fitted to a window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def savitzky_golay(df: DataFrame, key: str, order: str, value: str, window: int = 5, degree: int = 3) -> DataFrame:
    """``df`` with ``smooth``: the value at each row of the polynomial fitted to the ``window`` rows around it.

    The first and last half window take the polynomial of the first and last whole
    window. Series shorter than the window stay as they are. ``order`` must be unique
    within a series. The cost is rows times window, in whole-stage expressions.
    """
    half = window // 2
    x = np.vander(np.arange(window) - half, degree + 1)
    fit = x @ np.linalg.pinv(x)  # row i: weights of the window's values in the fitted value i
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in fit])
    w = Window.partitionBy(key).orderBy(order)
    near = df.withColumns({
        "__n": F.count("*").over(Window.partitionBy(key)), "__i": F.row_number().over(w) - 1,
        "__x": F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w.rowsBetween(1 - window, window - 1)),
    })
    # Place of the row in its window, and of the window in the rows at hand.
    first = F.least(F.greatest(F.col("__i") - half, F.lit(0)), F.col("__n") - window)
    at = (F.col("__i") - first).cast("int")
    values = F.slice("__x", (first - F.greatest(F.col("__i") - (window - 1), F.lit(0)) + 1).cast("int"), window)
    products = F.zip_with(values, F.element_at(weights, at + 1), lambda a, b: a * b)
    smooth = F.when(F.col("__n") >= window, F.aggregate(products, F.lit(0.0), lambda a, b: a + b)).otherwise(F.col(value).cast("double"))
    return near.withColumn("smooth", smooth).drop("__n", "__i", "__x")
