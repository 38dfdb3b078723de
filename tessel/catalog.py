"""Catalogs: budgets (setups), methods, models and vision constants, as small DataFrames and validated look-ups on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Budget:
    """What a run may spend; None is unset, 0 is 0."""

    token_budget: int | None = None
    frame_count: int | None = None
    resolution: float | None = None
    decode_budget: int | None = None
    max_rounds: int = 0
    hi_i_count: int | None = None
    hi_resolution: float | None = None
    reference_frames: int | None = None
    presentation: str = "video"


@dataclass(frozen=True)
class Vision:
    """How a model family turns pixels into tokens."""

    patch: int
    merge: int
    tps: int
    min_pixels: int
    max_pixels: int
    clamp: str
    tmerge: int = 1

    @property
    def factor(self) -> int:
        return self.patch * self.merge


# Budgets, methods, models, constants, cost fields.
SETUPS: dict[str, Budget] = {
    "model_default_16f": Budget(frame_count=16, decode_budget=128),
    "model_default_32f": Budget(frame_count=32, decode_budget=128),
    "model_default_64f": Budget(frame_count=64, decode_budget=256),
    "native_16f": Budget(frame_count=16, resolution=1.0, decode_budget=16),
    "native_64f": Budget(frame_count=64, resolution=1.0, decode_budget=64),
    "native_256f": Budget(frame_count=256, resolution=1.0, decode_budget=256),
    "uniform_64f_r50": Budget(frame_count=64, resolution=0.5, decode_budget=64),
    "lowres_base_64f": Budget(frame_count=64, resolution=0.25, decode_budget=64),
    "lowres_base_128f": Budget(frame_count=128, resolution=0.25, decode_budget=128),
    "lowres_base_256f": Budget(frame_count=256, resolution=0.25, decode_budget=256),
    "lowres_base_512f": Budget(frame_count=512, resolution=0.25, decode_budget=512),
    "keyframe_16f_pool256": Budget(frame_count=16, resolution=1.0, decode_budget=256),
    "lohi_128f_r25_k8": Budget(frame_count=128, resolution=0.25, decode_budget=128, hi_i_count=8, reference_frames=16, presentation="lohi"),
    "lohi_128f_r25_k4": Budget(frame_count=128, resolution=0.25, decode_budget=128, hi_i_count=4, reference_frames=16, presentation="lohi"),
}
DEFAULT_SETUP, DEFAULT_METHOD = "lowres_base_256f", "lowres-base"
METHODS: dict[str, tuple[str, str]] = {
    "qwen-default": ("uniform", "identity"),
    "lowres-base": ("uniform", "identity"),
    "random-prune": ("uniform", "random"),
    "mmtok": ("uniform", "mmtok"),
    "flashvid": ("uniform", "flashvid"),
    "visionzip": ("uniform", "visionzip"),
    "cliptopk": ("cliptopk", "identity"),
    "aks": ("aks", "identity"),
    "lohi-uniform": ("lohi-uniform", "identity"),
    "lohi-semdiv": ("lohi-semdiv", "identity"),
}
SIGNALS = {"uniform": "uniform", "lohi-uniform": "none", "cliptopk": "retrieval", "aks": "similarity", "semdiv": "query_similarity", "lohi-semdiv": "query_similarity"}
MODELS: dict[str, str] = {"qwen3-vl-4b": "none", "qwen3-vl-8b": "none", "qwen3-vl-4b-thinking": "always", "qwen3.5-4b": "hybrid", "qwen2.5-vl-7b": "none"}
FAMILIES: dict[str, Vision] = {
    "qwen3_vl": Vision(16, 2, 2, 131072, 786432, "3d"),
    "qwen3_5": Vision(16, 2, 2, 200704, 1605632, "3d"),
    "qwen2_5_vl": Vision(14, 2, 2, 100352, 602112, "2d"),
}
COSTS = ("decode_seconds", "frames_decoded", "vit_flops", "frames_encoded", "vit_patch_tokens", "prefill_tokens", "decode_tokens", "thinking_tokens", "llm_visual_tokens", "rounds", "wall_seconds")
REAL_COSTS = ("decode_seconds", "vit_flops", "wall_seconds")
PRUNE_DEFAULTS: dict[str, dict] = {
    "identity": {},
    "random": {"keep_ratio": 0.25, "seed": 0},
    "mmtok": {"keep_ratio": 0.25, "alpha": 0.5, "tv_temp": 0.01, "vv_temp": 0.2, "greedy": "lazy"},
    "visionzip": {"keep_ratio": 0.25, "alpha": 0.928571},
    "flashvid": {"keep_ratio": 0.25, "alpha": 0.7, "segment_threshold": 0.9, "min_segment_num": 8, "temporal_threshold": 0.8, "do_segment": True, "complementary_segment": True},
}


def setup(name: str) -> Budget:
    if name not in SETUPS:
        raise KeyError(f"unknown setup {name!r}; known: {', '.join(sorted(SETUPS))}")
    return SETUPS[name]


def method(name: str) -> tuple[str, str]:
    """(selector, pruner) of a method."""
    if name not in METHODS:
        raise KeyError(f"unknown method {name!r}; known: {', '.join(sorted(METHODS))}")
    return METHODS[name]


def family(model: str) -> str:
    m = model.lower()
    return "qwen2_5_vl" if "2.5" in m or "2_5" in m else "qwen3_5" if "3.5" in m or "3_5" in m else "qwen3_vl"


def vision(model: str) -> Vision:
    return FAMILIES[family(model)]


def check_thinking(mode: str, enabled: bool | None) -> None:
    """none can't think, always can't stop; a hybrid model must be told."""
    if mode not in ("none", "hybrid", "always"):
        raise ValueError(f"unknown thinking mode {mode!r}")
    if mode == "none" and enabled:
        raise ValueError("this model doesn't think; thinking can't be on")
    if mode == "always" and enabled is False:
        raise ValueError("this model always thinks; thinking can't be off")


def template_kwargs(mode: str, enabled: bool | None) -> dict:
    return {} if mode == "always" else {"enable_thinking": bool(enabled)}


def prune_json(text: str | None) -> dict:
    """Parameters given as JSON on a command line: an object, or nothing."""
    if not text:
        return {}
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"pruner parameters aren't JSON: {e}") from None
    if not isinstance(got, dict):
        raise ValueError(f"pruner parameters are a JSON object, not {type(got).__name__}")
    return got


def prune_parameters(pruner: str, given: dict | None = None) -> dict:
    """Defaults with what is given on top; unknown names and ratios outside (0, 1] raise."""
    out = {**PRUNE_DEFAULTS[pruner]}
    for k, v in (given or {}).items():
        if k not in out and k != "token_budget":
            raise ValueError(f"unknown parameter {k!r} of {pruner}; known: {', '.join(sorted(out))}")
        out[k] = v
    for k in ("keep_ratio", *(("alpha",) if pruner == "visionzip" else ())):
        if k in out and not 0 < out[k] <= 1:
            raise ValueError(f"{k} must be in (0, 1], got {out[k]}")
    return out


def setups_frame(spark: SparkSession) -> DataFrame:
    types = {"resolution": "double", "hi_resolution": "double", "presentation": "string"}
    schema = "setup string, " + ", ".join(f"{f.name} {types.get(f.name, 'bigint')}" for f in fields(Budget))
    return spark.createDataFrame([(n, *asdict(b).values()) for n, b in SETUPS.items()], schema)


def methods_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, p, SIGNALS[s]) for n, (s, p) in METHODS.items()], "method string, selector string, pruner string, signal string")


def vision_frame(spark: SparkSession) -> DataFrame:
    rows = [(n, v.patch, v.merge, v.factor, v.tps, v.tmerge, v.min_pixels, v.max_pixels, v.clamp) for n, v in FAMILIES.items()]
    return spark.createDataFrame(rows, "family string, patch bigint, merge bigint, factor bigint, tps bigint, tmerge bigint, min_pixels bigint, max_pixels bigint, clamp string")


def models_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, t, family(m)) for m, t in MODELS.items()], "model string, thinking string, family string")
