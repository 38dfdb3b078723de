"""Connected components of a graph of 64-bit vertices, by least labels and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

MAX_ROUNDS = 60
LOCAL_EDGES = 1 << 18  # of 16 bytes: 4 MB at most go to the driver


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (a, b), and the least vertex of each one's component."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(v))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return v, v[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of edges (a, b): root is the least vertex of v's component. edges is read more than once.

    Up to LOCAL_EDGES edges, counted first, are labelled in one place. Beyond that each round takes the least label among a vertex and its
    neighbours, then that label's own label; labels only fall, and the number of rounds follows the logarithm of a component's diameter in
    practice. Every round is a table in the shared folder."""
    if edges.count() <= LOCAL_EDGES:
        few = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
        v, root = least_labels(few.column("a").to_numpy(), few.column("b").to_numpy())
        return materialize(edges.sparkSession.createDataFrame(pa.table({"v": v, "root": root}), "v long, root long"), "labels")
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("m"))
        hook = labels.join(near, "v").select("v", "root", F.least("root", "m").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("root").alias("far"))
        new = materialize(hook.join(jump, "next", "left").select("v", F.col("root").alias("old"), F.least("next", F.coalesce("far", "next")).alias("root")), "labels")
        if new.filter("old <> root").isEmpty():
            return new.select("v", "root")
        labels = new.select("v", "root")
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
