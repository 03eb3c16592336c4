"""Regression metrics from one aggregate (log and price scale) and axis bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: str, pred: str, price: str | None = None,
                       pred_price: str | None = None) -> DataFrame:
    """R^2, MAE and RMSE on the log scale, MAE/RMSE on the price scale, n and
    the common axis bounds of actual and predicted price -- one pass.  R^2 is
    NULL for a constant target."""
    e = F.col(y) - F.col(pred)
    spread = F.nullif(F.count(F.lit(1)) * F.var_pop(y), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("n"), (F.lit(1.0) - F.try_divide(F.sum(e * e), spread)).alias("r2_log"),
            F.avg(F.abs(e)).alias("mae_log"), F.sqrt(F.avg(e * e)).alias("rmse_log")]
    if price:
        ep = F.col(price) - F.col(pred_price)
        aggs += [F.avg(F.abs(ep)).alias("mae_price"), F.sqrt(F.avg(ep * ep)).alias("rmse_price"),
                 F.least(F.min(price), F.min(pred_price)).alias("axis_min"),
                 F.greatest(F.max(price), F.max(pred_price)).alias("axis_max")]
    return df.agg(*aggs)
