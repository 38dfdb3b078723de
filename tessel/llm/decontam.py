"""Benchmark decontamination by spaced seeds, DataFrame functions only.

A mask fixes which of a window's words count; the others may differ. Each window of a benchmark item is hashed under the masks of its length, and
each window of a document under all. All masks hold the same two neighbours, so a join on that pair's hash goes first and the masks are hashed
for what it leaves. A hit aligns an item with a place in a document; the item's words are then compared with those of the document one by
one, and the item leaks if 0.75 of them agree.

With a quarter of an item's words replaced, wherever they are, some mask still finds it: by trial of every choice this holds for items of 5 to 24
words. Rows that are shuffled hold a place and a window of words, never a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import SPACE_CLASS

#: Offsets of the words that count, the first two next to each other, with the least and most words of items that are hashed so.
LONG = 10
MASKS = (((0, 1, 3, 4), 0, 2**31), ((0, 1, 2, 3), LONG, 2**31), ((0, 1, 2, 5), LONG, 2**31), ((0, 1, 4, 6), LONG, 2**31), ((0, 1, 2), 0, LONG - 1))
SPAN = 7
MIN_WORDS = 5  # a few words are no sign of a leak
THRESHOLD = 0.75
#: Punctuation and symbols before a word's first other character or behind its last; a word of nothing else stays.
_SPACES, _MARKS = r"\x20\x09-\x0D", r"\p{P}\p{S}"
AT_ENDS = f"(?<![^{_SPACES}])[{_MARKS}]++(?=[^{_SPACES}])|(?<=[^{_SPACES}{_MARKS}])[{_MARKS}]++(?![^{_SPACES}])"
BROADCAST_WORDS = 1_000_000  # seeds of 40 bytes for each mask and word: 200 MB at most
BROADCAST_HITS = 500_000  # rows of 40 bytes


def _word_hashes(text: str) -> Column:
    # In upper case ß is often SS, and both small sigmas are one letter.
    folded = F.replace(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    words = F.split(F.regexp_replace(folded, AT_ENDS, ""), f"{SPACE_CLASS}+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, pos and w0..w6: one row for every word of the array h; words past the end are null."""
    shifted = ", ".join(["h", *(f"slice(h, {k + 1}, greatest(size(h) - {k}, 0))" for k in range(1, SPAN))])
    x = df.select(*keep, F.expr(f"posexplode(arrays_zip({shifted}))").alias("pos", "z"))
    fields = [f.name for f in x.schema["z"].dataType.fields]
    return x.select(*keep, "pos", *[F.col("z").getField(f).alias(f"w{k}") for k, f in enumerate(fields)])


def _pair() -> Column:
    return F.xxhash64("w0", "w1")


def _seeds(n: str | None = None) -> Column:
    """The seeds of a window, of an item of n words those of its masks; null where the window ends before the mask does."""
    each = []
    for i, (mask, least, most) in enumerate(MASKS):
        there = F.col(f"w{mask[-1]}").isNotNull()
        each.append(F.when(there & F.col(n).between(least, most) if n else there, F.xxhash64(F.lit(i), *[F.col(f"w{k}") for k in mask])))
    return F.explode(F.array(*each)).alias("seed")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, item_id, start (word where the item would begin), n_words (of the item), n_equal, overlap: each pair's best alignment.

    Words are runs outside [\\x20\\x09-\\x0D]; they are compared without regard to the case of any letter and to punctuation at their ends. overlap = n_equal / n_words, at least threshold. Defined cases: items of fewer
    than MIN_WORDS words match nothing; null texts have no words; an item that hangs over a document's edge has no equal words
    there; rows that share a doc_id with other texts are reported apart by text_hash; repeated items and documents give one row; null ids are
    kept as such; either table empty gives no rows."""
    # Equal items are one; an item's array of hashes is carried by its number.
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _word_hashes("text").alias("h")).filter(F.size("h") >= MIN_WORDS).distinct()
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "h")).withColumn("n", F.size("h")), "items")
    words = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small = F.broadcast if words <= BROADCAST_WORDS else lambda x: x  # the side's size is checked; beyond it the joins shuffle
    of_items = _windows(items, ["item", "n"]).filter("w1 is not null")
    pairs = of_items.select(_pair().alias("pair")).distinct()
    seeds = of_items.select("item", F.col("pos").alias("j"), _seeds("n")).filter("seed is not null")

    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    base = keys.select("doc_id", "text_hash", _word_hashes("text").alias("h"))
    near = _windows(base, ["doc_id", "text_hash"]).filter("w1 is not null").withColumn("pair", _pair()).join(small(pairs), "pair", "left_semi")
    own = near.select("doc_id", "text_hash", "pos", _seeds()).filter("seed is not null")
    hits = materialize(own.join(small(seeds), "seed").select("doc_id", "text_hash", "item", (F.col("pos") - F.col("j")).alias("start")).distinct(), "hits")
    few = F.broadcast if hits.count() <= BROADCAST_HITS else lambda x: x  # as above
    # The words of the texts that are hit, and of each only the part that the item would cover.
    same = lambda x: keys["doc_id"].eqNullSafe(x["__d"]) & (keys["text_hash"] == x["__h"])
    texts = hits.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    found = keys.join(few(texts), same(texts), "left_semi").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), _word_hashes("text").alias("h"))
    bodies = items.select("item", "item_id", F.col("h").alias("body"))
    wide = found.join(few(hits), F.col("__d").eqNullSafe(hits["doc_id"]) & (F.col("__h") == hits["text_hash"])).join(small(bodies), "item")
    cover = F.expr("slice(h, greatest(start, 0) + 1, greatest(size(body) + least(start, 0), 0))")
    body = F.expr("slice(body, greatest(-start, 0) + 1, size(body))")
    hit = wide.select("doc_id", "text_hash", "item_id", "start", F.size("body").alias("n_words"), cover.alias("x"), body.alias("y"))
    equal = F.expr("aggregate(zip_with(x, y, (a, b) -> if(a = b, 1, 0)), 0, (s, v) -> s + coalesce(v, 0))")
    good = hit.withColumn("n_equal", equal).filter(F.col("n_equal") >= F.col("n_words") * threshold)
    best = good.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("s"), "n_words")).alias("m"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("m.s")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"), F.col("m.n_equal").cast("long").alias("n_equal"), (F.col("m.n_equal") / F.col("m.n_words")).alias("overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no benchmark item; columns and other rows as they were."""
    bad = leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_anti")
