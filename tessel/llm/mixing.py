"""Mixing sources to target weights with Pfair windows and earliest deadline first.

Block j (from 0) of a source of weight w is released at slot floor(j / w) and due by slot ceil((j + 1) / w). One slot takes one block;
among the released blocks the earliest deadline goes first. Weights are the target weights as exact fractions, never rounded. Where they
repeat within a period of few slots, one period is worked out on the driver and every block's slot follows by arithmetic; else the driver works
out the slot of every block there is (five numbers a block of BLOCK_ROWS rows). Up to the slot where a source runs out, each source's share
deviates from its target weight by less than one block.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize

BLOCK_ROWS, PERIOD, MAX_SOURCES = 16, 1024, 100_000
BUCKETS = 64
BROADCAST_BLOCKS = 1_000_000  # rows of under 100 bytes


def integer_weights(weights: dict, period: int = PERIOD) -> dict:
    """Largest-remainder rounding of positive weights to integers that sum to period (or to len(weights) if that is more), each at least 1."""
    if not weights:
        return {}
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    total, period = math.fsum(weights.values()), max(period, len(weights))
    names = sorted(weights, key=lambda k: (k is not None, k))
    free = period - len(names)
    exact = [weights[k] / total * free for k in names]
    got = [math.floor(x) for x in exact]
    for i in sorted(range(len(names)), key=lambda i: (got[i] - exact[i], i))[: free - sum(got)]:
        got[i] += 1
    return {k: 1 + g for k, g in zip(names, got, strict=True)}


def exact_weights(weights: dict) -> dict:
    """Positive weights as integers in exactly the same proportions, without a common factor."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    names = sorted(weights, key=lambda k: (k is not None, k))
    exact = [Fraction(weights[k]) for k in names]
    scale = math.lcm(*[x.denominator for x in exact])
    whole = [int(x * scale) for x in exact]
    common = math.gcd(*whole)
    return {k: x // common for k, x in zip(names, whole, strict=True)}


def pfair_schedule(weights: dict[str | None, int], blocks: dict[str | None, int]) -> tuple[array, array, array, array, array]:
    """Source (its place in weights), k, slot, release and deadline of each block, for integer weights and a number of blocks for each source.

    Ties go to the source listed first; the slots of a source that has run out stay empty."""
    total, each, last = sum(weights.values()), list(weights.values()), [blocks[k] for k in weights]
    out = array("i"), array("q"), array("q"), array("q"), array("q")
    waiting = [(0, i, 0) for i in range(len(each)) if last[i]]
    ready: list[tuple] = []
    heapq.heapify(waiting)
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // each[i]), i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        if deadline >= 2**63:
            raise ValueError("a weight is too small for its rows: slots go beyond 64 bits")
        for to, x in zip(out, (i, k, slot, release, deadline), strict=True):
            to.append(x)
        if k + 1 < last[i]:
            heapq.heappush(waiting, ((k + 1) * total // each[i], i, k + 1))
        slot += 1
    return out


def pfair_period(weights: dict[str | None, int]) -> list[tuple]:
    """(source, k, slot, release, deadline) of each block of one period, for integer weights; ties go to the source listed first."""
    names = list(weights)
    return [(names[i], *x) for i, *x in zip(*pfair_schedule(weights, weights), strict=True)]


def source_ranks(docs: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """docs with __rank: its place (from 0) within its source. A source is cut into hash buckets, which are counted first, so a source with
    a third of all rows is ranked by as many tasks as any other rows; a bucket's offset is a sum over at most BUCKETS counts or, for more rows, more buckets."""
    keyed = docs.withColumn("__o", order[0])
    n = docs.count()
    buckets = max(BUCKETS, n // 50_000)
    keyed = keyed.withColumn("__b", F.pmod(F.col("__o"), F.lit(buckets)))
    counts = keyed.groupBy(source, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = W.partitionBy(source).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(source).alias("__s"), F.col("__b").alias("__ob"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    within = W.partitionBy(source, "__b").orderBy("__o", *order[1:])
    ranked = keyed.withColumn("__r", F.row_number().over(within) - 1)
    joined = ranked.join(offsets, ranked[source].eqNullSafe(offsets["__s"]) & (ranked["__b"] == offsets["__ob"]), "left")
    return joined.withColumn("__rank", (F.col("__r") + F.col("__off")).cast("long")).drop("__o", "__b", "__r", "__s", "__ob", "__off")


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, block_rows: int = BLOCK_ROWS, period: int = PERIOD, seed: int = 0, source: str = "source") -> DataFrame:
    """docs with mix_block, mix_slot, mix_release, mix_deadline and mix_offset added; every row stays, once.

    mix_block: the number of its block within its source; rows of a source are dealt to blocks in hash order of doc_id. mix_slot: the slot of
    that block, unique over all blocks; (mix_slot, mix_offset) is a total order of the rows, and reading in it is the mixture.
    weights: target weight by source, positive; sources not named get the least weight named. None: row counts to the power of temperature.
    period: most slots of a schedule that is repeated rather than worked out in full; weights hold exactly either way.
    Defined cases: a null source is a source of its own; once a source runs out its slots stay empty and the others keep their proportions;
    repeated rows are rows of their own; an empty table gives no rows; more than MAX_SOURCES sources raise ValueError."""
    spark, added = docs.sparkSession, ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_offset"]
    docs = docs.drop(*added)
    # One row per source, and never more than the bound.
    counted = docs.groupBy(source).count().limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        target = {r[0]: float(r[1]) ** temperature for r in counted}
    else:
        least = min(weights.values(), default=1.0)
        target = {r[0]: float(weights.get(r[0], least)) for r in counted}
    whole = exact_weights(target) if target else {}
    total, names = sum(whole.values()), list(whole)
    repeats = total <= period
    i, *numbers = pfair_schedule(whole, whole if repeats else {r[0]: -(-r[1] // block_rows) for r in counted})
    kind = docs.schema[source].dataType.simpleString()
    of = spark.createDataFrame([(n, s, whole[s] if repeats else 2**63 - 1) for n, s in enumerate(names)], f"__i int, __qs {kind}, __n long")
    plan = spark.createDataFrame(pa.table([pa.array(i, pa.int32()), *[pa.array(x, pa.int64()) for x in numbers]], ["__p", "__k", "__slot", "__rel", "__due"]))
    ranked = source_ranks(docs, source, [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")])
    # One row a source, bounded by MAX_SOURCES; one a block, whose number is known here: beyond the limit the join shuffles.
    x = ranked.join(F.broadcast(of), ranked[source].eqNullSafe(F.col("__qs")))
    x = x.withColumn("mix_block", F.expr(f"__rank div {block_rows}")).withColumn("mix_offset", F.col("__rank") % block_rows)
    x = x.withColumn("__cycle", F.expr("mix_block div __n")).withColumn("__j", F.col("mix_block") % F.col("__n"))
    x = x.join(F.broadcast(plan) if len(i) <= BROADCAST_BLOCKS else plan, (F.col("__i") == F.col("__p")) & (F.col("__j") == F.col("__k")))
    total = total if repeats else 0
    at = lambda c: (F.col("__cycle") * total + F.col(c)).cast("long")
    return x.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_block", at("__slot").alias("mix_slot"), at("__rel").alias("mix_release"), at("__due").alias("mix_deadline"), "mix_offset")
