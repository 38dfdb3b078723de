"""Exact token and resolution arithmetic as column expressions. Rounding is half to even (rint) where not said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def idiv(a, b) -> Column:
    """Integer quotient of non-negative integers, exact at any size."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.call_function("div", a, b)


def ceil_div(a, b) -> Column:
    return idiv(col(a).cast("long") + col(b).cast("long") - 1, b)


def guard(ok: Column, message, value: Column) -> Column:
    """value where ok holds, else an error that fails the query."""
    return F.when(ok, value).otherwise(F.raise_error(col(message)).cast("long"))


def decode_indices(total, budget) -> Column:
    """Evenly spaced frame numbers from first to last: all if budget is null or covers total, none for 0, an error below 0."""
    total, budget = col(total).cast("long"), col(budget).cast("long")
    n = F.coalesce(F.least(budget, total), total)
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda i: F.when(n <= 1, F.lit(0)).otherwise(idiv((total - 1) * i, F.greatest(n - 1, F.lit(1)))).cast("long"))
    bad = F.raise_error(F.lit("a decode budget can't be negative")).cast("array<bigint>")
    return F.when(budget < 0, bad).when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(spread))


def center_indices(total, count) -> Column:
    """The middles of count equal segments; all frames if count covers them."""
    total, count = col(total).cast("long"), col(count).cast("long")
    k = F.coalesce(F.least(count, total), total)
    mid = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k, F.lit(1)) - 1), lambda i: F.least(total - 1, idiv((2 * i + 1) * total, 2 * F.greatest(k, F.lit(1)))))
    return F.when(k <= 0, F.array().cast("array<bigint>")).otherwise(mid)


def hi_indices(total, count) -> Column:
    """count evenly spaced frames from first to last; the middle one for a count of 1."""
    total, count = col(total).cast("long"), col(count).cast("long")
    return F.when(F.least(count, total) == 1, F.array(idiv(total, 2))).otherwise(decode_indices(total, count))


def resize_side(side, r, factor) -> Column:
    """side scaled by r, to the nearest multiple of factor, one factor at least."""
    return F.greatest(col(factor).cast("long"), (F.rint(col(side) * col(r).cast("double") / col(factor)) * col(factor)).cast("long"))


def smart_resize(h, w, factor, low, high) -> tuple[Column, Column]:
    """Both sides to multiples of factor with an area in [low, high]; aspect ratios over 200 are errors."""
    h, w, f = col(h).cast("double"), col(w).cast("double"), col(factor).cast("double")
    hb, wb = F.rint(h / f) * f, F.rint(w / f) * f
    down, up = F.sqrt(h * w / col(high)), F.sqrt(col(low) / (h * w))
    fits = F.greatest(h, w) / F.least(h, w) <= 200

    def side(x, rounded):
        return guard(fits, "aspect ratio over 200", F.when(hb * wb > col(high), F.greatest(f, F.floor(x / down / f) * f)).when(hb * wb < col(low), F.ceil(x * up / f) * f).otherwise(rounded).cast("long"))

    return side(h, hb), side(w, wb)


def temporal_groups(n, tps) -> Column:
    return guard(col(n) > 0, "frames must be positive", ceil_div(n, tps))


def video_tokens(n, h, w, v) -> Column:
    """Visual tokens of n frames of h x w; v: columns of a family (factor, tps, tmerge, min_pixels, max_pixels, clamp) by name."""
    t = temporal_groups(n, v["tps"])
    merged = ceil_div(t, v["tmerge"])
    fh, fw = smart_resize(h, w, v["factor"], v["min_pixels"], v["max_pixels"])
    flat = merged * idiv(fh, v["factor"]) * idiv(fw, v["factor"])
    # The 3-D clamp holds the padded frames' total area against the limits times the groups.
    f, frames = v["factor"].cast("double"), (t * v["tps"]).cast("double")
    hd, wd = col(h).cast("double"), col(w).cast("double")
    hb, wb = F.rint(hd / f) * f, F.rint(wd / f) * f
    area, high, low = frames * hb * wb, v["max_pixels"] * t, v["min_pixels"] * t
    down, up = F.sqrt(frames * hd * wd / high), F.sqrt(low / (frames * hd * wd))
    pick = lambda x, b: F.when(area > high, F.greatest(f, F.floor(x / down / f) * f)).when(area < low, F.ceil(x * up / f) * f).otherwise(b)
    deep = merged * idiv(pick(hd, hb).cast("long"), v["factor"]) * idiv(pick(wd, wb).cast("long"), v["factor"])
    return F.when(v["clamp"] == "3d", deep).otherwise(flat)


def max_frames(tokens, h, w, v) -> Column:
    """Most frames of h x w whose tokens fit; an error if not one does."""
    fh, fw = smart_resize(h, w, v["factor"], v["min_pixels"], v["max_pixels"])
    per = idiv(fh, v["factor"]) * idiv(fw, v["factor"])
    n = idiv(tokens, per) * v["tps"] * v["tmerge"]
    return guard(n > 0, "the token budget is below one group of frames", n)


def max_pixels(tokens, n, v) -> Column:
    """Largest area a frame may have for n frames to fit; an error if not even one token a frame does."""
    groups = ceil_div(temporal_groups(n, v["tps"]), v["tmerge"])
    per = idiv(tokens, groups)
    return guard(per > 0, "the token budget is below one token a group", per * v["factor"] * v["factor"])


def metadata_fps(native, effective) -> Column:
    return F.when(col(native) > 0, col(native)).when(col(effective) > 0, col(effective)).otherwise(F.lit(2.0))


def keep_ceil(pre, ratio, budget=None) -> Column:
    """Tokens kept: the budget if set, else ratio rounded up; in [1, pre]."""
    want = F.coalesce(col(budget).cast("long"), F.ceil(col(pre) * col(ratio).cast("double")).cast("long"))
    return guard(col(pre) > 0, "nothing to keep from", F.least(F.greatest(want, F.lit(1)), col(pre).cast("long")))


def keep_even(pre, ratio, budget=None) -> Column:
    """As keep_ceil, but the ratio is rounded half to even."""
    want = F.coalesce(col(budget).cast("long"), F.rint(col(pre) * col(ratio).cast("double")).cast("long"))
    return F.least(F.greatest(want, F.lit(1)), col(pre).cast("long"))


def softmax_fits(heads, seq, limit=8 * 2**30) -> Column:
    """Whether heads * seq * seq floats of 4 bytes stay within limit."""
    return col(heads).cast("long") * col(seq).cast("long") * col(seq).cast("long") * 4 <= limit


def prefill(width, pre, post, markers) -> Column:
    """Sequence length the language model really ran on."""
    return F.greatest(F.lit(1).cast("long"), col(width) - (col(pre) - col(post)) - col(markers))


def llm_visual_tokens(encoded: Column, has_frames: Column, images: Column | None = None, post: Column | None = None) -> Column:
    """Visual tokens that enter the language model: what pruning leaves, else both streams' tokens, else the encoded ones; without frames none, unless pruned or of two streams."""
    zero = F.lit(0).cast("long")
    one = F.when(has_frames, F.coalesce(encoded, zero)).otherwise(zero)
    both = one if images is None else F.coalesce(F.coalesce(encoded, zero) + images, one)
    return both if post is None else F.coalesce(post, both)


def is_noop(keep: Column, pre: Column) -> Column:
    """Whether pruning to keep of pre tokens leaves all of them, so that the dense path runs."""
    return keep >= pre


def checked_tokens(made: Column, expected: Column) -> Column:
    """made, failing at run time where it isn't the expected number of tokens."""
    message = F.concat(F.lit("tokens made: "), made.cast("string"), F.lit(", expected: "), expected.cast("string"))
    return F.when(made.eqNullSafe(expected), made).otherwise(F.raise_error(message).cast("long"))


@F.pandas_udf(StructType([StructField("gh", LongType()), StructField("gw", LongType())]))
def _nearest_grid(th: pd.Series, tw: pd.Series, most: pd.Series, ratio: pd.Series) -> pd.DataFrame:
    """The best grid of at most most tokens around th x tw scaled to most, a batch of rows at once; 1 x 1 where ratio is null."""
    h, w, m, r = (x.to_numpy(float, na_value=np.nan) for x in (th, tw, most, ratio))
    gh, gw = np.ones(len(h)), np.ones(len(h))
    at = np.flatnonzero(np.isfinite(r))
    h, w, m, r = h[at], w[at], m[at], r[at]
    scale = np.sqrt(m / (h * w))
    (ha, hz), (wa, wz) = ((np.maximum(1, np.floor(t * scale) - 2), np.maximum(1, np.minimum(t, np.floor(t * scale) + 3))) for t in (h, w))
    best = [np.full(len(h), v) for v in (-1.0, 0.0, 0.0, 1.0, 1.0)]  # near, size, err, grid
    for x in (ha + i for i in range(6)):
        for y in (wa + j for j in range(6)):
            with np.errstate(divide="ignore"):
                err = np.abs(np.log((y / x) / r))
            near = (err <= 0.08).astype(float)
            size = np.where(near == 1, x * y, -err)
            # Grids come by height, then width, so that the first of equals stays.
            better = (near > best[0]) | ((near == best[0]) & ((size > best[1]) | ((size == best[1]) & (err < best[2]))))
            better &= (x <= hz) & (y <= wz) & (x * y <= m)
            best = [np.where(better, new, old) for new, old in zip((near, size, err, x, y), best, strict=True)]
    gh[at], gw[at] = best[3], best[4]
    return pd.DataFrame({"gh": gh.astype(np.int64), "gw": gw.astype(np.int64)})


def fit_grid(h: Column, w: Column, factor: Column, most: Column) -> Column:
    """struct(fit_h, fit_w): the largest grid of at most most tokens whose aspect ratio is within 8 % of the native one, else that of the nearest ratio.

    A search over some 36 grids around the scaled one, inside the row, in Arrow batches. most below 1 fails at run time."""
    th, tw = (idiv(resize_side(x, F.lit(1.0), factor), factor) for x in (h, w))
    m = F.when(most >= 1, most.cast("long")).otherwise(F.raise_error(F.lit("a grid needs one token at least")).cast("long"))
    whole = th * tw <= m
    best = _nearest_grid(th, tw, m, F.when(~whole, w / h))
    return F.struct((F.when(whole, th).otherwise(best["gh"]) * factor).alias("fit_h"), (F.when(whole, tw).otherwise(best["gw"]) * factor).alias("fit_w"))
