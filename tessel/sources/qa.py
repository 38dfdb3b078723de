"""Question sets: scans with validation, video files, subtitles, and the conversion of a released table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip, strip_option
from ..operators.relational import key, unique

SCHEMA = "video_id string, question_id string, question string, options array<string>, answer string, subtitle_path string, task_type string, domain string, sub_category string, duration string"
REQUIRED = ("video_id", "question", "options", "answer")
EXTENSIONS = ("mp4", "mkv", "webm")


def _checked(df: DataFrame, ok, message) -> DataFrame:
    """df, failing at run time where ok doesn't hold; the check is a filter, so no optimisation drops it."""
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of SCHEMA with ord, one object a line; blank lines are skipped, a line that is no object of these types fails with its place.

    ord grows with the place in the file; it is the line number (from 0) in a file of one split."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter(F.trim(F.col("value")) != "")
    schema = StructType.fromDDL(SCHEMA + ", _bad string")
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.regexp_like(F.col("value"), F.lit(r"^\s*\{")) & F.col("r").isNotNull() & F.col("r._bad").isNull()
    good = _checked(parsed, ok, F.concat(F.lit("line "), (F.col("ord") + 1).cast("string"), F.lit(" is not a JSON object of the schema: "), F.left("value", F.lit(80))))
    return good.select("ord", *[f"r.{c}" for c in schema.names if c != "_bad"])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    have = {f.name: f for f in df.schema.fields}
    want = StructType.fromDDL(SCHEMA)
    cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in want.fields]
    return df.select(F.monotonically_increasing_id().alias("ord"), *[c.alias(f.name) for c, f in zip(cols, want.fields, strict=True)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A question set by its suffix: .parquet, else lines of JSON; required fields must be there and keys unique."""
    df = read_parquet(spark, path) if path.rstrip("/").endswith(".parquet") else read_jsonl(spark, path)
    ok = F.lit(True)
    for c in REQUIRED:
        ok &= F.col(c).isNotNull()
    full = _checked(df, ok, F.concat(F.lit("a required field is missing at row "), F.col("ord").cast("string")))
    return unique(full.withColumn("key", key()), "key")


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """stem, path, rank of the files under root with one of these extensions; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.element_at(F.split(name, r"\."), -1)
    return found.select(F.substr(name, F.lit(1), F.char_length(name) - F.char_length(ext) - 1).alias("stem"), "path", F.array_position(F.array(*[F.lit(e) for e in extensions]), ext).alias("rank"))


def with_videos(df: DataFrame, listing: DataFrame, required: bool = True) -> DataFrame:
    """df with video_path: the file named by video_id, an explicit extension first, then by the order of extensions; without one the query fails."""
    best = listing.groupBy("stem").agg(F.min_by("path", "rank").alias("__by_stem"))
    exact = listing.select(F.element_at(F.split("path", "/"), -1).alias("__name"), F.col("path").alias("__exact"))
    x = df.join(best, df["video_id"] == best["stem"], "left").drop("stem").join(exact, F.col("video_id") == F.col("__name"), "left").drop("__name")
    x = x.withColumn("video_path", F.coalesce("__exact", "__by_stem")).drop("__exact", "__by_stem")
    return _checked(x, F.col("video_path").isNotNull(), F.concat(F.lit("no video file for "), F.col("video_id"))) if required else x


def bare(path: Column) -> Column:
    """A path without scheme and authority, so that names match on any file system."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", ""), "/+", "/")


def with_subtitles(spark: SparkSession, df: DataFrame, root: str, enabled: bool = True) -> DataFrame:
    """df with subtitles, the text of subtitle_path (relative ones lie under root); a file that is named but missing fails the query."""
    if not enabled:
        return df.withColumn("subtitles", F.lit(None).cast("string"))
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("subtitles"), bare(F.col("_metadata.file_path")).alias("__p"))
    named = F.col("subtitle_path")
    full = bare(F.when(named.startswith("/") | named.contains("://"), named).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), named)))
    x = df.withColumn("__want", full).join(texts, F.col("__want") == F.col("__p"), "left")
    return _checked(x, F.col("subtitle_path").isNull() | F.col("subtitles").isNotNull(), F.concat(F.lit("missing subtitles "), F.col("subtitle_path"))).drop("__want", "__p")


def prepare(release: DataFrame, subtitles: DataFrame | None = None) -> DataFrame:
    """A released table as question records: ids and answer as text, option prefixes off, optional columns passed on, subtitle_path where subtitles (stem, path) has it."""
    passed = [F.col(c).cast("string").alias(c) if c in release.columns else F.lit(None).cast("string").alias(c) for c in ("duration", "domain", "sub_category", "task_type")]
    out = release.select(
        F.col("videoID").cast("string").alias("video_id"), F.col("question_id").cast("string").alias("question_id"), F.col("question").cast("string").alias("question"),
        F.transform("options", strip_option).alias("options"), strip(F.col("answer").cast("string")).alias("answer"), *passed,
    )
    if subtitles is None:
        return out.withColumn("subtitle_path", F.lit(None).cast("string"))
    found = subtitles.select(F.col("stem").alias("video_id"), F.col("path").alias("subtitle_path"))
    return out.join(found, "video_id", "left")


def missing_videos(df: DataFrame, listing: DataFrame) -> DataFrame:
    """video_id of questions without an .mp4 file; a warning, not an error."""
    return df.join(listing.filter(F.col("path").endswith(".mp4")).select(F.col("stem").alias("video_id")), "video_id", "left_anti").select("video_id").distinct()


def counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("video_id").alias("videos"), F.count_if(F.col("subtitle_path").isNotNull()).alias("with_subtitles"))
