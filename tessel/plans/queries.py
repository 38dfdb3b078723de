"""Registered queries: every operator applied to the driver's tables, which stand in for videos, questions and runs.

A video is a user of events (frames: events in order of time, score: value) or a label of embeddings (frames: vectors in order of id, the query: the
first vector); sizes come from part, texts from conversations and documents, run rows from orders, the cost ledger from lineitem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalog
from ..functions import numeric, text
from ..operators import encoding, merging, reduction, relational, scoring, selection
from ..sources import qa, video
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c: Column) -> Column:
    """An array of numbers as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, idx, score: frames of each user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("value").alias("score"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, total: the number of frames of each user."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample")).agg(F.count(F.lit(1)).alias("total"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, idx, embedding (doubles), score: cosine to the sample's first vector."""
    w = W.partitionBy("label").orderBy("vec_id")
    x = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("sample"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    first = x.filter("idx = 0").select("sample", F.col("embedding").alias("q"))
    return x.join(first, "sample").select("sample", "idx", "embedding", selection.cosine(F.col("embedding"), F.col("q")).alias("score"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, h, w, n, r and the constants of a vision family for each part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    k = F.col("id")
    p = p.select("id", (40 + k * 37 % 1500).alias("h"), (60 + k * 53 % 2400).alias("w"), (1 + k % 150).alias("n"), ((1 + k % 4) / 4.0).alias("r"), F.element_at(F.array(F.lit("qwen3_vl"), F.lit("qwen3_5"), F.lit("qwen2_5_vl")), (k % 3 + 1).cast("int")).alias("family"))
    return p.join(F.broadcast(catalog.vision_frame(spark)), "family")  # three rows


def family_columns() -> dict[str, Column]:
    return {c: F.col(c) for c in ("factor", "tps", "tmerge", "min_pixels", "max_pixels", "clamp")}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run rows: F is right, O wrong, P an error."""
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_orderpriority").alias("method"), F.year("o_orderdate").cast("long").alias("setup"), F.when(s == "F", True).when(s == "O", False).alias("correct"), F.when(s == "P", "error").otherwise("ok").alias("status"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as stage costs."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("long").alias("key"), F.col("l_quantity").cast("double").alias("decode_seconds"), F.col("l_partkey").cast("long").alias("prefill_tokens"), F.col("l_suppkey").cast("long").alias("vit_patch_tokens"), F.col("l_extendedprice").cast("double").alias("vit_flops"))


SOME_COSTS = ("decode_seconds", "vit_flops", "prefill_tokens", "vit_patch_tokens")


@query
def accuracy_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage costs folded into runs, then accuracy and mean costs by method."""
    rows = results(spark, sf_dir).join(scoring.fold(ledger(spark, sf_dir), ["key"], SOME_COSTS), "key", "left")
    s = scoring.summary(rows, ["method"], SOME_COSTS)
    return s.select("method", "n", "errors", *[F.round(c, 4).alias(c) for c in ("accuracy", *(f"mean_{c}" for c in SOME_COSTS))])


@query
def cost_ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.fold(ledger(spark, sf_dir), ["key"], ("decode_seconds", "prefill_tokens", "vit_patch_tokens"))
    return x.select("key", F.round("decode_seconds", 4).alias("decode_seconds"), "prefill_tokens", "vit_patch_tokens")


@query
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    x = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")).join(d, "doc_id")
    return scoring.category_accuracy(x, "lang").filter("level = 0").select("lang", "n", "scored", F.round("accuracy", 6).alias("accuracy"))


@query
def rollup_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    x = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")).join(d, "doc_id")
    return scoring.category_accuracy(x, "lang", "source").select("lang", "source", "n", "scored", F.round("accuracy", 6).alias("accuracy"), "level")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 8 + F.col("turn")
    letter = F.substr(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1))
    t = F.col("text")
    shaped = (
        F.when(k % 7 == 0, F.concat(F.lit("The answer is "), letter)).when(k % 7 == 1, F.concat(F.lit(" ("), F.lower(letter), F.lit(") "), t)).when(k % 7 == 2, F.concat(t, F.lit(" [[ b ]] or {{"), letter, F.lit("}}")))
        .when(k % 7 == 3, letter).when(k % 7 == 4, F.concat(t, F.lit("\nOption: "), letter, F.lit("!"))).when(k % 7 == 5, t).otherwise(F.lit("??"))
    )
    gold = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.lower(letter), F.lit(". ")))
    return c.select("conv_id", "turn", shaped.alias("prediction"), gold.alias("gold"))


@query
def mcq_extract_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _answers(spark, sf_dir)
    return x.select("conv_id", "turn", text.extract_choice(F.col("prediction")).alias("choice"), text.score_mcq(F.col("prediction"), F.col("gold")).alias("correct"))


@query
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    q = F.concat(F.col("role"), F.lit(" {options} "), F.col("text"))
    return c.select("conv_id", "turn", text.build_prompt(q, F.array("text", "role", F.col("conv_id").cast("string"))).alias("prompt"))


@query
def shard_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return relational.shard(e, "event_id", 1, 4)


@query
def filter_limit_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the users that are building customers, then the first 500 rows, then every third from place 2."""
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    e = relational.matching(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", wanted)
    return relational.shard(relational.limit(e, "event_id", 500), "event_id", 2, 3)


@query
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golds joined by key: the question's id, else the video's; null where there is none."""
    c = table(spark, sf_dir, "conversations")
    x = c.select(F.when(F.col("turn") % 2 == 0, F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))).alias("question_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("video_id"))
    golds = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("key"), F.col("quality").cast("long").alias("gold"))
    return relational.with_golds(x.withColumn("key", relational.key()), golds).select("key", "gold")


@query
def uniform_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = F.when(F.col("sample") % 5 == 0, F.lit(None)).otherwise(F.col("sample") % 5 * 7 - 7)
    return pools(spark, sf_dir).select("sample", joined(numeric.decode_indices(F.col("total"), budget)).alias("indices"))


@query
def uniform_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.uniform(pools(spark, sf_dir), 16).select("sample", joined(F.col("indices")).alias("indices"), F.size(selection.per_frame_resolution(F.col("indices"), 0.25)).cast("long").alias("n"))


@query
def lohi_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = selection.lohi_uniform(pools(spark, sf_dir), 8)
    return x.select("sample", F.size("indices").cast("long").alias("n_lo"), joined(F.col("hi_indices")).alias("hi"), (F.size(F.array_except("hi_indices", "indices")) == 0).alias("subset"))


@query
def timestamps_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame times of a decode plan, and the strictly increasing numbers made of them at a lower rate."""
    v = pools(spark, sf_dir).select(F.col("sample").alias("video_id"), F.col("total").alias("total_frames"), F.lit(25.0).alias("native_fps"), F.lit(360).alias("native_h"), F.lit(640).alias("native_w"))
    plan = video.decode_plan(v, catalog.Budget(decode_budget=15, resolution=0.5))
    ts = F.transform("indices", lambda i: i / F.col("native_fps"))
    x = plan.withColumn("numbers", video.pad_last(video.mrope(ts, F.lit(8.0)), 2))
    return x.select("video_id", joined(F.col("numbers")).alias("numbers"), F.round("fps", 6).alias("fps"), "height", "width", F.round(numeric.metadata_fps(F.lit(0.0), F.col("fps")), 6).alias("metadata_fps"))


@query
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos through decoding, scores and selection, bad ones of two kinds among them: these become error rows, and the others go on."""
    p = pools(spark, sf_dir)
    v = p.select("sample", F.col("total").alias("total_frames"), F.when(F.col("sample") % 7 != 0, 25.0).otherwise(0.0).alias("native_fps"), F.lit(360).alias("native_h"), F.lit(640).alias("native_w"))
    plan = video.decode_plan(v, catalog.Budget(decode_budget=15, resolution=0.5), keep_errors=True)
    scores = timeline(spark, sf_dir).filter("sample % 5 <> 0 or idx <> 1")
    bad = plan.join(selection.coverage_errors(scores, p), "sample", "left").withColumn("error", F.coalesce("error", "score_error"))
    top = selection.top_k(scores, 1).select("sample", F.col("idx").alias("best"))
    good = F.col("error").isNull()
    return bad.join(top, "sample", "left").select("sample", F.when(good, "ok").otherwise("error").alias("status"), "error", F.when(good, F.size("indices")).otherwise(0).cast("long").alias("frames"), F.when(good, F.col("best")).alias("best"))


@query
def resize_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("id", numeric.resize_side(F.col("h"), F.col("r"), F.col("factor")).alias("height"), numeric.resize_side(F.col("w"), F.col("r"), F.col("factor")).alias("width"))


@query
def fit_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = numeric.fit_grid(F.col("h"), F.col("w"), F.col("factor"), 1 + F.col("id") * 7 % 400)
    return sizes(spark, sf_dir).select("id", grid.alias("g")).select("id", "g.fit_h", "g.fit_w")


@query
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = numeric.smart_resize(F.col("h"), F.col("w"), F.col("factor"), F.col("min_pixels"), F.col("max_pixels"))
    return sizes(spark, sf_dir).select("id", h.alias("height"), w.alias("width"))


@query
def video_tokens_2d3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = family_columns()
    return sizes(spark, sf_dir).select("id", "family", numeric.video_tokens(F.col("n"), F.col("h"), F.col("w"), v).alias("tokens"), numeric.temporal_groups(F.col("n"), F.col("tps")).alias("groups"))


@query
def budget_solvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = family_columns()
    return sizes(spark, sf_dir).select("id", numeric.max_frames(F.lit(200000), F.col("h"), F.col("w"), v).alias("frames"), numeric.max_pixels(F.lit(20000), F.col("n"), v).alias("pixels"))


@query
def dual_stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of n low-resolution frames at a quarter a side and of 8 images that fill up the budget of 16 native frames."""
    return encoding.dual_stream(sizes(spark, sf_dir)).select("id", "lo", "hi", "tokens", F.round("hi_scale", 4).alias("hi_scale"))


@query
def encode_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-stream encoding at a scale: padded frames, tokens, patches and the size limits handed on."""
    return encoding.single_stream(sizes(spark, sf_dir)).select("id", "frames", "tokens", "patches", "shortest", "longest")


@query
def softmax_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("id", numeric.softmax_fits(F.lit(16), F.col("h") * 11).alias("fits"))


@query
def topk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_k(vectors(spark, sf_dir), 8).select("sample", "idx")


@query
def topk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    return selection.top_k(selection.covered(t, pools(spark, sf_dir)), 5).select("sample", "idx")


@query
def aks_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.adaptive(timeline(spark, sf_dir), 8, 0.45, 0.1, 3).select("sample", "idx")


@query
def semdiv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.quality(timeline(spark, sf_dir), 5.0).select("sample", "idx", F.round("quality", 6).alias("quality"))


@query
def semdiv_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.diverse(vectors(spark, sf_dir), 8)


@query
def keep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = F.when(F.col("id") % 4 == 0, F.col("id") % 60).cast("long")
    ratio = (1 + F.col("id") % 20) / 20.0
    return sizes(spark, sf_dir).select("id", numeric.keep_ceil(F.col("n"), ratio, budget).alias("up"), numeric.keep_even(F.col("n"), ratio, budget).alias("even"))


@query
def random_keep_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of each sample's frames, by hash."""
    t = timeline(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("sample")))
    return reduction.hash_sample(t.withColumnRenamed("idx", "tok"), numeric.keep_ceil(F.col("n"), F.lit(0.25)), F.col("sample")).select("sample", "tok")


@query
def query_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed of a query, by the hash's first bits; as text, as it has 64 bits without sign."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", reduction.seed_from_query(0, F.col("text")).cast("string").alias("seed"))


@query
def random_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pre = F.char_length("text").cast("long") + 1
    return c.select("conv_id", "turn", joined(reduction.random_sample(pre, numeric.keep_ceil(pre, F.lit(0.25)), reduction.seed_from_query(0, F.col("text")).cast("string"))).alias("kept"))


@query
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", text.keywords(F.concat(F.lit("Question: "), F.col("text"), F.lit(text.CANNED[0]))).alias("keywords"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three query vectors a sample."""
    return vectors(spark, sf_dir).filter("idx < 3").select("sample", F.col("idx").alias("word_idx"), F.col("embedding").alias("feat"))


@query
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the text half of the coverage matrix, the best column of each row and the rows' sums."""
    t = vectors(spark, sf_dir).select("sample", F.col("idx").alias("tok"), F.col("embedding").alias("feat"))
    p = reduction.coverage_rows(t, _words(spark, sf_dir), 0.2)
    return p.groupBy("sample", "word_idx").agg(F.max_by("tok", F.struct(F.round("p", 9), -F.col("tok"))).alias("best"), F.round(F.sum("p"), 6).alias("total"))


@query
def mmtok_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = vectors(spark, sf_dir).select("sample", F.col("idx").alias("tok"), F.col("embedding").alias("feat"), F.col("embedding").alias("img_feat"))
    return reduction.coverage(t, _words(spark, sf_dir))


def _attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("sample", F.col("idx").alias("tok"), F.col("embedding").alias("feat"), F.round("score", 4).alias("attention"), F.col("embedding").alias("attn_key"))


@query
def visionzip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.zip_plan(_attended(spark, sf_dir), 0.5, 0.7)


@query
def visionzip_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of each kept token's values."""
    t = _attended(spark, sf_dir)
    m = reduction.zip_merge(t, reduction.zip_plan(t))
    return m.select("sample", "tok", F.round(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query
def segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = vectors(spark, sf_dir).select("sample", "idx", F.col("embedding").alias("mean"))
    return reduction.segment_lengths(f, threshold=-0.2, least=12).select("sample", "segment", "length")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tokens of frames of five, incomplete frames left out as a frame has a fixed number of tokens."""
    x = vectors(spark, sf_dir).withColumn("frame", numeric.idiv(F.col("idx"), F.lit(5))).withColumn("pos", F.col("idx") % 5)
    full = F.count(F.lit(1)).over(W.partitionBy("sample", "frame"))
    x = x.withColumn("__n", full).filter("__n = 5").drop("__n")
    return x.select("sample", "frame", "pos", F.col("idx").alias("tok"), F.transform("embedding", lambda v: F.abs(v)).alias("feat"), F.abs("score").alias("attention"))


@query
def farthest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.farthest(_grid(spark, sf_dir), 2)


@query
def temporal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that stay, with the sum of each one's merged values."""
    m = reduction.merge_temporally(_grid(spark, sf_dir), 0.6, 2)
    return m.select("sample", "frame", "pos", F.round(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query
def dpc_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.cluster(_grid(spark, sf_dir), 6)


@query
def flashvid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.flash(_grid(spark, sf_dir), ratio=0.4, min_segment_num=2).select("sample", "tok")


@query
def sequence_subselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a sequence: first and last are markers, every fourth is text, the others are visual; those of most value stay."""
    t = timeline(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("sample")))
    kind = F.when((F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1), "marker").when(F.col("idx") % 4 == 0, "text").otherwise("visual")
    s = t.withColumn("kind", kind).withColumn("local", F.when(F.col("kind") == "visual", F.row_number().over(W.partitionBy("sample", "kind").orderBy("idx")) - 1).cast("long"))
    s = s.select("sample", F.col("idx").alias("pos"), "kind", "local", F.col("score").alias("value"))
    kept = selection.top_k(s.filter("kind = 'visual'"), 6, score="value", idx="local").select("sample", "local", (F.col("value") * 2).alias("value"))
    return reduction.subselect(s, kept).select("sample", "pos", "kind", F.round("value", 6).alias("value"))


@query
def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    full = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("hm</think> "), F.col("text"), F.lit("</think> x "))).otherwise(F.col("text"))
    a, d, t = text.split_thinking(full, F.lit(9).cast("long"), F.col("conv_id") % 2 == 0)
    return c.select("conv_id", "turn", a.alias("answer"), d.alias("decode_tokens"), t.alias("thinking_tokens"))


@query
def prefill_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual tokens that enter the model, and the sequence length it runs on, after pruning to a ratio; a ratio of 1 runs dense."""
    pre = F.col("n") * 64
    post = numeric.keep_even(pre, F.col("r"))
    dense = numeric.is_noop(post, pre)
    return sizes(spark, sf_dir).select("id", F.when(dense, pre).otherwise(post).alias("llm_visual_tokens"), F.when(dense, pre + 40).otherwise(numeric.prefill(pre + 40, pre, post, F.lit(2))).alias("prefill_tokens"))


@query
def lohi_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a dual-stream message whose stamps are quarter seconds."""
    c = table(spark, sf_dir, "conversations")
    stamps = text.one_decimals(F.array(F.col("conv_id") / 4.0, F.col("conv_id") / 4.0 + F.col("turn"), F.col("turn") + 12.375))
    parts = text.lohi_content(F.col("text"), F.col("stamps"))
    return c.withColumn("stamps", stamps).select("conv_id", "turn", F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit("="), p["text"])), "|").alias("content"))


@query
def model_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    names = F.array(*[F.lit(m) for m in (*catalog.MODELS, "Qwen2_5-VL", "other")])
    return p.select("id", text.family(F.element_at(names, (F.col("id") % 7 + 1).cast("int"))).alias("family"))


@query
def catalog_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by setups with their frames and whether a dual-stream method has what it needs: a bounded cross of two catalogs."""
    m, s = catalog.methods_frame(spark), catalog.setups_frame(spark)
    ok = ~F.col("selector").startswith("lohi") | F.col("hi_i_count").isNotNull()
    return m.crossJoin(F.broadcast(s)).select("method", "setup", "selector", "pruner", "signal", "frame_count", ok.alias("valid"))


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    options = F.array(F.concat(F.lit(" A. "), F.col("url")), F.concat(F.lit("B) b."), k.cast("string")), F.lit("no prefix"), F.lit("C.D. x"))
    return p.select(numeric.idiv(k, F.lit(3)).alias("videoID"), k.alias("question_id"), F.col("url").alias("question"), options.alias("options"), F.concat(F.lit("\n B "), F.lit("\t")).alias("answer"), F.when(k % 3 == 0, k).alias("domain"))


def _subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each video that a customer's number names."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("stem"))
    return c.select("stem", F.concat(F.lit("/s/"), F.col("stem"), F.lit(".srt")).alias("path"))


@query
def prepare_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = _subtitles(spark, sf_dir)
    x = qa.prepare(_released(spark, sf_dir), subs)
    return x.select("video_id", "question_id", F.array_join("options", "|").alias("options"), "answer", "domain", "subtitle_path")


@query
def prepare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = _subtitles(spark, sf_dir)
    return qa.counts(qa.prepare(_released(spark, sf_dir), subs))


@query
def video_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each page's video: .mp4 before .mkv before .webm."""
    p = table(spark, sf_dir, "pages")
    ext = F.array(*[F.lit(e) for e in qa.EXTENSIONS])
    files = p.withColumn("stem", (F.col("page_id") % 40).cast("string")).withColumn("e", F.element_at(ext, (F.col("page_id") % 7 % 3 + 1).cast("int"))).select("stem", F.concat(F.lit("/v/"), F.col("page_id").cast("string"), F.lit("/"), F.col("stem"), F.lit("."), F.col("e")).alias("path"), F.array_position(ext, F.col("e")).alias("rank"))
    files = files.groupBy("stem", "rank").agg(F.min("path").alias("path"))
    ids = p.select((F.col("page_id") % 60).cast("string").alias("video_id")).distinct()
    return qa.with_videos(ids, files, required=False).select("video_id", "video_path")


def _shards(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders as the rows of three overlapping shards."""
    r = results(spark, sf_dir).select(F.lit(None).cast("string").alias("question_id"), F.col("key").cast("string").alias("video_id"), "correct", "status", F.col("setup").alias("prefill_tokens"), F.col("key").alias("ord"))
    return [r.filter(F.col("ord") % 3 == 0), r.filter(F.col("ord") % 3 != 2).drop("status"), r.filter(F.col("ord") % 3 == 2)]


@query
def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame([(i, "m", "x") for i in range(3)], "shard int, model string, method string")
    a, b, c = _shards(spark, sf_dir)
    rows, s = merging.merge([a.drop("status"), b, c.drop("status")], runs, "ord")
    return s.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_prefill_tokens", 4).alias("mean_prefill_tokens"), F.round("mean_wall_seconds", 4).alias("mean_wall_seconds"))


@query
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key once, from the first shard that has it."""
    return merging.first_seen(merging.union(_shards(spark, sf_dir)), ["shard", "ord"]).select("key", F.col("shard").cast("long").alias("shard"), "status")


@query
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _shards(spark, sf_dir)
    off = b.withColumn("prefill_tokens", F.when(F.col("ord") % 9 == 0, F.lit(-1)).otherwise(F.col("prefill_tokens")))
    return merging.conflicts(merging.union([a.drop("status"), off, c.drop("status")]), ["video_id", "correct", "prefill_tokens"])


@query
def merge_meta_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = results(spark, sf_dir).groupBy("setup").agg(F.max("method").alias("method"), F.count(F.lit(1)).alias("n")).select(F.lit("m").alias("model"), "method", F.col("setup").cast("string").alias("setup"))
    return merging.agreement(runs)


@query
def dry_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method under four setups on the conversations as questions: n, errors, accuracy and mean costs."""
    c = table(spark, sf_dir, "conversations")
    s = c.select((F.col("conv_id") * 1024 + F.col("turn")).alias("sample"), F.col("text").alias("query"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit(None)), (F.col("conv_id") % 3 + 1).cast("int")).alias("gold"))
    out = None
    for m in catalog.METHODS:
        for b in ("lowres_base_256f", "model_default_16f", "keyframe_16f_pool256", "lohi_128f_r25_k8"):
            one = scoring.summary(pipeline.dry_run(s, m, b)).select(F.lit(m).alias("method"), F.lit(b).alias("setup"), "n", "errors", F.round("accuracy", 6).alias("accuracy"), *[F.round(f"mean_{x}", 4).alias(f"mean_{x}") for x in ("frames_decoded", "frames_encoded", "vit_patch_tokens", "prefill_tokens", "decode_seconds")])
            out = one if out is None else out.unionByName(one)
    return out
