"""Selecting frames of an ordered sequence for each sample: uniform, by score, by adaptive partition, by diversity.

Frames are long tables (sample, idx, ...); idx counts from 0. Rankings have a total order: score downwards, then idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric

AKS_T1, AKS_T2, AKS_DEPTH = 0.8, -100.0, 5


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def uniform(pools: DataFrame, count: int | None, total: str = "total") -> DataFrame:
    """pools with indices: the middles of count equal segments."""
    return pools.withColumn("indices", numeric.center_indices(F.col(total), F.lit(count)))


def lohi_uniform(pools: DataFrame, hi: int | None, total: str = "total") -> DataFrame:
    """pools with indices (all frames) and hi_indices (hi of them, from first to last)."""
    if hi is None:
        raise ValueError("dual-stream selection needs hi_i_count")
    every = numeric.decode_indices(F.col(total), F.lit(None))
    return pools.withColumn("indices", every).withColumn("hi_indices", numeric.hi_indices(F.col(total), F.lit(hi)))


def per_frame_resolution(indices: Column, resolution: float | None) -> Column:
    if resolution is None:
        return F.lit(None).cast("array<double>")
    return F.transform(indices, lambda _: F.lit(float(resolution)))


def top_k(scores: DataFrame, k: int, sample: str = "sample", score: str = "score", idx: str = "idx") -> DataFrame:
    """The k frames of highest score of each sample; Spark keeps k rows a group before the shuffle."""
    return scores.withColumn("__r", F.row_number().over(W.partitionBy(sample).orderBy(F.desc(score), idx))).filter(F.col("__r") <= k).drop("__r")


def covered(scores: DataFrame, pools: DataFrame, sample: str = "sample", total: str = "total") -> DataFrame:
    """scores, failing at run time for a sample whose scores don't cover its pool."""
    n = F.count(F.lit(1)).over(W.partitionBy(sample))
    x = scores.join(pools.select(sample, F.col(total).alias("__t")), sample).withColumn("__ok", F.when(n == F.col("__t"), F.lit(True)).otherwise(F.raise_error(F.lit("a scorer must score every frame")).cast("boolean")))
    return x.filter("__ok").drop("__ok", "__t")


def coverage_errors(scores: DataFrame, pools: DataFrame, sample: str = "sample", total: str = "total") -> DataFrame:
    """sample, score_error of the samples of pools (one row each) whose scores don't cover their pool, those without any score included."""
    n = scores.groupBy(sample).agg(F.count(F.lit(1)).alias("__n"))
    x = pools.select(sample, F.col(total).cast("long").alias("__t")).join(n, sample, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    told = F.concat(F.lit("ValueError: "), F.col("__n").cast("string"), F.lit(" scores for "), F.col("__t").cast("string"), F.lit(" frames"))
    return x.filter(~F.col("__n").eqNullSafe(F.col("__t"))).select(sample, F.coalesce(told, F.lit("ValueError: a pool of unknown size")).alias("score_error"))


def depth_cap(num: int, depth: int = AKS_DEPTH) -> int:
    """depth, but no deeper than floor(log2(num))."""
    return 0 if num <= 1 else min(depth, num.bit_length() - 1)


def min_max(score: Column, over) -> Column:
    lo, hi = F.min(score).over(over), F.max(score).over(over)
    return F.when(hi > lo, (score - lo) / (hi - lo)).otherwise(F.lit(0.0))


def adaptive(scores: DataFrame, num: int, t1: float = AKS_T1, t2: float = AKS_T2, depth: int = AKS_DEPTH, sample: str = "sample", score: str = "score", idx: str = "idx") -> DataFrame:
    """sample, idx: frames by recursive halving. A segment is kept whole where its top num stand out from its mean by t1 and its deviation
    exceeds t2, or at depth; a kept segment at depth d gives its int(num / 2**d) best frames. Fewer frames than num are all taken.

    The segments depend on the number of frames alone, so a frame's segment at every depth follows from halving its place that often (a fixed
    number of steps, at most depth + 1 rows a frame); there is no recursion over data."""
    if num <= 0:
        return scores.select(sample, idx).limit(0)
    every = W.partitionBy(sample)
    x = scores.select(sample, F.col(idx).cast("long").alias("idx"), F.col(score).cast("double").alias("score"))
    x = x.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("s", min_max(F.col("score"), every))
    # (node, start, length) at each depth: the left half has length div 2.
    node, start, size = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("n")
    steps = [F.struct(F.lit(0).alias("d"), node.alias("node"))]
    for d in range(depth):
        x = x.withColumn(f"n{d}", node).withColumn(f"a{d}", start).withColumn(f"z{d}", size)
        node, start, size = F.col(f"n{d}"), F.col(f"a{d}"), F.col(f"z{d}")
        half = numeric.idiv(size, 2)
        right = F.col("idx") >= start + half
        node, start, size = node * 2 + right.cast("long"), F.when(right, start + half).otherwise(start), F.when(right, size - half).otherwise(half)
        steps.append(F.struct(F.lit(d + 1).alias("d"), node.alias("node")))
    rows = x.select(sample, "idx", "s", "n", F.explode(F.array(*steps)).alias("at")).select(sample, "idx", "s", "n", "at.d", "at.node")
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(sample, "node").orderBy(F.desc("s"), "idx")))
    seg = W.partitionBy(sample, "node")
    ranked = ranked.withColumn("peak", (F.avg(F.when(F.col("r") <= num, F.col("s"))).over(seg) - F.avg("s").over(seg) > t1) & (F.stddev_pop("s").over(seg) > t2))
    # The first depth at which a frame's segment is final is its leaf.
    final = ranked.withColumn("final", F.col("peak") | (F.col("d") >= depth)).filter("final").withColumn("first", F.min("d").over(W.partitionBy(sample, "idx")))
    leaf = final.filter("d = first").filter(F.col("r") <= F.floor(F.lit(num) / F.pow(F.lit(2.0), "d")))
    small = scores.withColumn("__n", F.count(F.lit(1)).over(every)).filter(F.col("__n") < num).select(sample, F.col(idx).cast("long").alias("idx"))
    return leaf.filter(F.col("n") >= num).select(sample, "idx").unionByName(small).withColumnRenamed("idx", idx)


def quality(scores: DataFrame, alpha: float = 5.0, sample: str = "sample", score: str = "score") -> DataFrame:
    """scores with quality: the min-max scaled score to the power alpha; 1 where all scores of a sample are equal."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    every = W.partitionBy(sample)
    lo, hi = F.min(score).over(every), F.max(score).over(every)
    return scores.withColumn("quality", F.when(hi > lo, F.pow((F.col(score) - lo) / (hi - lo), F.lit(float(alpha)))).otherwise(F.lit(1.0)))
