"""Accuracy, mean costs and the cost ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import COSTS, REAL_COSTS


def fold(ledger: DataFrame, by: list[str], costs: tuple[str, ...] = COSTS) -> DataFrame:
    """Stage costs summed field by field: the ledger's rows of each key into one."""
    return ledger.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("double" if c in REAL_COSTS else "long").alias(c) for c in costs])


def accuracy(correct: Column) -> Column:
    """Share of right answers among those scored; null if none is."""
    return F.avg(correct.cast("double"))


def summary(results: DataFrame, by: list[str] | None = None, costs: tuple[str, ...] = COSTS) -> DataFrame:
    """n, errors, accuracy and mean_<cost> over all rows, errors included with what cost they have; one row without by, also over no rows."""
    present = [c for c in costs if c in results.columns]
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"), accuracy(F.col("correct")).alias("accuracy")]
    aggs += [F.coalesce(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"mean_{c}") for c in present]
    out = results.groupBy(*by).agg(*aggs) if by else results.agg(*aggs)
    for c in costs:
        if c not in present:
            out = out.withColumn(f"mean_{c}", F.lit(0.0))
    return out


def category_accuracy(results: DataFrame, *levels: str) -> DataFrame:
    """Accuracy and n for each combination of levels, and rolled up from the right."""
    return results.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.count("correct").alias("scored"), accuracy(F.col("correct")).alias("accuracy"), F.grouping_id().cast("long").alias("level"))
