"""Video scans: which frames a budget decodes, their times and sizes, as columns; pixels only through a codec that is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Budget
from ..functions import numeric


RATE_ERROR = "a video's frame rate must be positive"


def decode_plan(videos: DataFrame, budget: Budget, factor: int = 32, keep_errors: bool = False) -> DataFrame:
    """videos (native_h, native_w, native_fps, total_frames) with indices, fps (effective), height and width of decoded frames.

    A video without a positive frame rate fails the job; with keep_errors it stays as a row without frames, its error in the column error."""
    total, good = F.col("total_frames"), F.coalesce(F.col("native_fps") > 0, F.lit(False))
    if keep_errors:
        x = videos.withColumn("error", F.when(~good, F.lit(f"ValueError: {RATE_ERROR}")))
    else:
        x = videos.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(RATE_ERROR)).cast("boolean")))
    x = x.withColumn("indices", F.when(good, numeric.decode_indices(total, F.lit(budget.decode_budget))).otherwise(F.array().cast("array<bigint>")))
    seconds = F.when(good, total / F.col("native_fps"))
    x = x.withColumn("fps", F.when(seconds > 0, F.size("indices") / seconds).otherwise(F.lit(0.0)))
    side = lambda c: numeric.resize_side(F.col(c), F.lit(budget.resolution), F.lit(factor)) if budget.resolution is not None else F.col(c).cast("long")
    return x.withColumn("height", side("native_h")).withColumn("width", side("native_w"))


def frames(plan: DataFrame) -> DataFrame:
    """One row a decoded frame: place (in the pool), idx (in the video) and ts in seconds."""
    return plan.select(*[c for c in plan.columns if c != "indices"], F.posexplode("indices").alias("place", "idx")).withColumn("ts", F.col("idx") / F.col("native_fps"))


def mrope(ts: Column, fps: Column) -> Column:
    """Strictly increasing frame numbers of an array of times: the k-th is k more than the largest of number_j - j so far."""
    first = F.transform(ts, lambda t, k: F.rint(t * fps).cast("long") - k)
    return F.transform(first, lambda _, k: F.array_max(F.slice(first, F.lit(1), k + 1)) + k)


def pad_last(values: Column, tps: int) -> Column:
    """values with the last one repeated up to a multiple of tps."""
    short = F.pmod(-F.size(values), F.lit(tps))
    return F.when(F.size(values) > 0, F.concat(values, F.array_repeat(F.element_at(values, -1), short))).otherwise(values)


def decode(plan: DataFrame, codec: Callable[[bytes, list[int], int, int], list[bytes]], content: str = "content", keep_errors: bool = False) -> DataFrame:
    """Frames as bytes from the files' content: codec(file, frame numbers, height, width) returns one payload a number; runs on the executors.

    What the codec raises fails the job. With keep_errors, for a plan made so too, there is a column error, and a video that the plan or the
    codec refuses is one row with its error and without a frame."""
    key = plan.schema["video_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                made, error = None, r.error if keep_errors else None
                if error is None:
                    try:
                        got = codec(getattr(r, content), list(r.indices), int(r.height), int(r.width))
                        if len(got) != len(r.indices):
                            raise ValueError(f"{len(got)} payloads for {len(r.indices)} frames")
                        made = pd.DataFrame({"video_id": r.video_id, "place": range(len(got)), "idx": list(r.indices), "payload": got})
                    except Exception as e:
                        if not keep_errors:
                            raise
                        error = f"{type(e).__name__}: {e}"
                if made is None:
                    none = pd.Series([None], dtype="Int64")
                    made = pd.DataFrame({"video_id": [r.video_id], "place": none, "idx": none, "payload": [None]})
                yield made.assign(error=error) if keep_errors else made

    more = ["error"] if keep_errors else []
    shape = f"video_id {key}, place long, idx long, payload binary" + (", error string" if keep_errors else "")
    return plan.select("video_id", "indices", "height", "width", content, *more).mapInPandas(run, shape)
