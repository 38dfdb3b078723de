"""Token accounting of the encoders, one row a video: h, w (native), n (frames), and the constants of its vision family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric


def area_bounds(area: Column, groups: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """The processor's size limits, widened so that frames of this area pass unchanged."""
    return F.least(area, least), F.greatest(area, most) * groups


def single_stream(df: DataFrame, scale: str = "r") -> DataFrame:
    """df with frames (padded to whole groups), tokens, patches, shortest and longest (size limits) of encoding all n frames at a scale of the native side.

    No frames make no tokens."""
    f, c = F.col("factor"), F.col
    h, w = (numeric.resize_side(c(x), c(scale), f) for x in ("h", "w"))
    groups = numeric.temporal_groups(c("n"), c("tps"))
    shortest, longest = area_bounds(h * w, groups, c("min_pixels"), c("max_pixels"))
    added = {
        "frames": groups * c("tps"),
        "tokens": numeric.ceil_div(groups, c("tmerge")) * numeric.idiv(h, f) * numeric.idiv(w, f),
        "patches": groups * numeric.idiv(h, c("patch")) * numeric.idiv(w, c("patch")),
        "shortest": shortest,
        "longest": longest,
    }
    return df.withColumns(added)


def _cells(scale: float) -> Column:
    f = F.col("factor")
    return numeric.idiv(numeric.resize_side(F.col("h"), F.lit(scale), f), f) * numeric.idiv(numeric.resize_side(F.col("w"), F.lit(scale), f), f)


def _merged_groups(n: Column) -> Column:
    return numeric.ceil_div(numeric.ceil_div(n, F.col("tps")), F.col("tmerge"))


def dual_stream(df: DataFrame, scale: float = 0.25, images: int = 8, reference_frames: int = 16, image_scale: float | None = None) -> DataFrame:
    """df with lo (tokens of n frames at scale), hi (tokens of the images), tokens (both) and hi_scale (side of an image against the native one).

    Images have the largest grid that the tokens of reference_frames native frames leave each of them, or with image_scale that scale of the native side."""
    f = F.col("factor")
    x = df.withColumn("lo", _merged_groups(F.col("n")) * _cells(scale)).withColumn("__ref", _merged_groups(F.lit(reference_frames)) * _cells(1.0))
    if image_scale is None:
        x = x.withColumn("__g", numeric.fit_grid(F.col("h"), F.col("w"), f, F.greatest(F.lit(1).cast("long"), F.floor((F.col("__ref") - F.col("lo")) / images))))
    else:
        x = x.withColumn("__g", F.struct(*[numeric.resize_side(F.col(c), F.lit(image_scale), f).alias(f"fit_{c}") for c in ("h", "w")]))
    gh, gw = F.col("__g.fit_h"), F.col("__g.fit_w")
    x = x.withColumn("hi", images * numeric.idiv(gh, f) * numeric.idiv(gw, f)).withColumn("hi_scale", F.sqrt(gh * gw / (F.col("h") * F.col("w")).cast("double")))
    return x.withColumn("tokens", F.col("lo") + F.col("hi")).drop("__ref", "__g")
