"""Row-level operators over an ordered sequence: positions, subsets, prefixes, strided shards, key checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


BUCKET_ROWS = 2_000_000


def with_position(df: DataFrame, order: str, into: str = "pos", buckets: int | None = None) -> DataFrame:
    """df with each row's place (from 0) by the numeric column order, whose values are unique.

    A window over all rows would run in one task. Here quantiles cut the order into buckets, the buckets' sizes (one row each) give offsets,
    and rows are numbered inside their buckets, in parallel; a quantile that is off costs balance only. Buckets: one for BUCKET_ROWS rows, 64 to 4096."""
    buckets = buckets or min(4096, max(64, df.count() // BUCKET_ROWS))
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / buckets for i in range(1, buckets)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(float(c)) for c in cuts])
        bucket = F.size(F.filter(bounds, lambda b: b < F.col(order).cast("double")))
    keyed = df.withColumn("__b", bucket)
    sizes = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # At most buckets rows, so one task and a broadcast are bounded.
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(W.partitionBy("__b").orderBy(order)) - 1
    return keyed.withColumn("__r", inside).join(F.broadcast(offsets), "__b").withColumn(into, (F.col("__r") + F.col("__off")).cast("long")).drop("__b", "__r", "__off")


def only(df: DataFrame, column: str, wanted: Iterable) -> DataFrame:
    """The rows whose column is wanted; wanted values that no row has raise ValueError with their list."""
    wanted = list(dict.fromkeys(wanted))
    kept = df.filter(F.col(column).isin(*wanted))
    # One row per wanted value at most.
    found = {r[0] for r in kept.select(column).distinct().collect()}
    missing = [w for w in wanted if w not in found]
    if missing:
        raise ValueError(f"not found in {column}: {missing}")
    return kept


def matching(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose column stands in the one column of wanted, a table of any size; null matches nothing."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("__w")).distinct()
    return df.join(ids, F.col(column) == F.col("__w"), "left_semi")


def limit(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by order; all but the last -n for a negative n; all for None."""
    if n is None:
        return df
    if n >= 0:
        return df.orderBy(order).limit(n)
    placed = with_position(df, order, "__p")
    return placed.filter(F.col("__p") < max(0, df.count() + n)).drop("__p")


def shard(df: DataFrame, order: str, i: int, n: int) -> DataFrame:
    """Every n-th row from the i-th, by place after all earlier filters."""
    if not 0 <= i < n:
        raise ValueError(f"a shard needs 0 <= i < n, got {i}/{n}")
    return with_position(df, order, "__p").filter(F.col("__p") % n == i).drop("__p")


def key(question_id: str = "question_id", video_id: str = "video_id") -> Column:
    """The question's id, else the video's; an empty id is an id."""
    return F.coalesce(question_id, video_id)


def unique(df: DataFrame, column: str) -> DataFrame:
    """df, failing at run time on a key that two rows share."""
    n = F.count(F.lit(1)).over(W.partitionBy(column))
    ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("duplicate key "), F.col(column).cast("string"))).cast("boolean"))
    return df.withColumn("__ok", ok).filter("__ok").drop("__ok")


def with_golds(df: DataFrame, golds: DataFrame, column: str = "key") -> DataFrame:
    """df with the columns of golds, null where a key has none; keys of golds alone are ignored."""
    return df.join(golds, column, "left")
