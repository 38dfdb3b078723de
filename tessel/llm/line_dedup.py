"""Line deduplication, DataFrame functions only.

Each line becomes a row of hashes, document and position. Hashes are dealt out in ranges and sorted by hash, document and
position, so one pass over a range streams the first occurrence of every line (that of the largest document) and marks the
others; what comes back is a bitmap of lines a document loses, never text. A hash with more rows than a small share of a
range would fill its range alone: such hashes (their number is bounded by that share) are counted with map-side partial
aggregation instead, and their few owners are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize
from .text import SPACE, ascii_lower

MIN_CHARS, MIN_DOCS = 20, 3
#: A line with more than 1/(HOT_SHARE * partitions) of all lines is hot, so there are at most HOT_SHARE * partitions such lines.
HOT_SHARE = 4


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, h1, h2, pos: one row for every line whose key has min_chars code points."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACE)))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(_lines()).alias("pos", "line"))
        .filter(F.char_length("line") >= min_chars)
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    )


def dropped_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, words array<bigint>: bit p % 64 of word p div 64 is set if the document loses line p.

    Only documents that lose lines have a row; words after the last set bit are left out."""
    spark = docs.sparkSession
    rows = materialize(line_rows(docs, min_chars), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1000, rows.count() // (HOT_SHARE * parts))
    # Hot lines: at most HOT_SHARE * partitions hashes, hence the broadcasts below are bounded.
    hot = materialize(rows.groupBy("h1", "h2").count().filter(F.col("count") > limit).select("h1", "h2"), "hot-lines")
    on = ["h1", "h2"]
    # A document's null id counts as the smallest one.
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    of_hot = rows.join(F.broadcast(hot), on, "left_semi").withColumn("ord", order)
    owners = of_hot.groupBy(*on).agg(F.countDistinct("ord").alias("n"), F.max("ord").alias("owner")).filter(F.col("n") >= min_docs)
    lost_hot = of_hot.join(F.broadcast(owners.select("h1", "h2", "owner")), on).filter(F.col("ord") < F.col("owner")).select("doc_id", "text_hash", "pos")
    # The others: ranges of hashes, each sorted by hash, document (largest first) and position. The window streams over that order:
    # the first occurrence is the owner's, and dense_rank counts the documents that follow it.
    cold = rows.join(F.broadcast(hot), on, "left_anti").withColumn("ord", order)
    stream = W.partitionBy(*on).orderBy(F.desc("ord"), "pos")
    lost_cold = (
        cold.repartitionByRange(parts, "h1")
        .withColumn("owner", F.first("ord").over(stream))
        .withColumn("rank", F.dense_rank().over(W.partitionBy(*on).orderBy(F.desc("ord"))))
        .withColumn("n", F.max("rank").over(W.partitionBy(*on)))
        .filter((F.col("n") >= min_docs) & (F.col("ord") < F.col("owner")))
        .select("doc_id", "text_hash", "pos")
    )
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    word = F.expr("cast(pos div 64 as int)")
    packed = lost_hot.unionByName(lost_cold).groupBy("doc_id", "text_hash", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    fill = "aggregate(sort_array(collect_list(struct(word, bits))), cast(array() as array<bigint>), (a, x) -> concat(a, array_repeat(0L, x.word - size(a)), array(x.bits)))"
    return packed.groupBy("doc_id", "text_hash").agg(F.expr(fill).alias("words"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_lines, n_dropped, kept_text and keep_bitmap added; every other column as it was, one row per row.

    keep_bitmap: the document's bitmap, a bit for each line and 1 for a kept one, compressed to run lengths: kept, dropped, kept ... lines, with a
    space between ("3 2 1" is 111001, "0 1 4" is 01111, "5" a document of five lines that loses none).

    A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z in lower case. Keys of min_chars code points found in min_docs
    distinct doc_ids lose all their lines except in the largest of these. Defined cases: a null or empty text is one empty line, which
    stays; a null doc_id is one document below all others; rows that share a doc_id count as one document and lose the same keys; a line
    that stands twice in the owner stays twice; an empty table gives no rows. Columns of docs with the names added here are replaced."""
    added = ["n_lines", "n_dropped", "kept_text", "keep_bitmap"]
    lost = dropped_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("words").alias("__w"))
    base = docs.drop(*added)
    joined = base.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left")
    gone = "(coalesce(shiftright(get(__w, cast({0} div 64 as int)), cast({0} % 64 as int)) & 1L, 0L) = 1L)"
    keeps = f"filter(__lines, (l, i) -> not {gone.format('i')})"
    # Where runs begin and end; the first run is one of kept lines, maybe empty.
    turns = f"filter(sequence(0, size(__lines) - 1), i -> if(i = 0, {gone.format('0')}, {gone.format('i')} <> {gone.format('(i - 1)')}))"
    edges = f"concat(array(0), {turns}, array(size(__lines)))"
    return (
        joined.withColumn("__lines", _lines())
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", F.expr("aggregate(coalesce(__w, cast(array() as array<bigint>)), 0L, (s, x) -> s + bit_count(x))").cast("long"))
        .withColumn("kept_text", F.when(F.col("__w").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.expr(keeps), "\n")))
        .withColumn("__e", F.when(F.col("__w").isNotNull(), F.expr(edges)))
        .withColumn("keep_bitmap", F.coalesce(F.expr("array_join(transform(slice(__e, 2, size(__e) - 1), (x, i) -> x - get(__e, i)), ' ')"), F.col("n_lines").cast("string")))
        .drop("__d", "__h", "__w", "__lines", "__e")
    )
