"""Merging the outputs of sharded runs: union, exact duplicates dropped, conflicts and differing runs refused, means taken anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import key
from .scoring import summary

#: What shards of one run must agree on.
META_KEYS = ("model", "method", "task", "setup", "thinking", "budget", "presentation")


def union(shards: list[DataFrame]) -> DataFrame:
    """All rows with shard (from 0); a column that one shard lacks is null there."""
    if not shards:
        raise ValueError("no shards given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("shard", F.lit(i)) for i, s in enumerate(shards)])


def conflicts(rows: DataFrame, payload: list[str]) -> DataFrame:
    """key and n_rows of keys whose rows differ anywhere in payload."""
    x = rows.withColumn("key", key()).withColumn("__j", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    return x.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("__j").alias("n_different")).filter("n_different > 1").select("key", "n_rows", "n_different")


def first_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row a key, the first by order."""
    r = F.row_number().over(W.partitionBy("key").orderBy(*order))
    return rows.withColumn("key", key()).withColumn("__r", r).filter("__r = 1").drop("__r")


def agreement(runs: DataFrame, keys: tuple[str, ...] = META_KEYS) -> DataFrame:
    """meta_key, n_values, agrees of each key; a missing value is a value. runs: one row a shard."""
    stacked = runs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("meta_key"), (F.coalesce(F.col(k).cast("string"), F.lit("\0none")) if k in runs.columns else F.lit("\0none")).alias("v")) for k in keys])).alias("s")).select("s.*")
    return stacked.groupBy("meta_key").agg(F.countDistinct("v").alias("n_values")).withColumn("agrees", F.col("n_values") <= 1)


def merge(shards: list[DataFrame], runs: DataFrame, order: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of the shards of one run, in order of shard and of order within it.

    Checked in turn: rows that share a key must be equal, there must be rows, and runs must agree on META_KEYS (with strict, on every column of runs)."""
    rows = union(shards)
    payload = [c for c in rows.columns if c not in ("shard", order)]
    bad = conflicts(rows, payload).limit(5).collect()
    if bad:
        raise ValueError(f"conflicting rows for keys {sorted(r['key'] for r in bad)}")
    merged = first_seen(rows, ["shard", order])
    if merged.isEmpty():
        raise ValueError("the shards have no rows")
    keys = META_KEYS if not strict else tuple(c for c in runs.columns if c not in ("shard", "n", "git_sha", "timestamp", "accuracy", "errors"))
    off = [r.meta_key for r in agreement(runs, keys).filter("not agrees").collect()]
    if off:
        raise ValueError(f"shards are not of one run: {sorted(off)} differ")
    status = merged if "status" in merged.columns else merged.withColumn("status", F.lit(None).cast("string"))
    return merged.drop("key"), summary(status).drop("errors")
