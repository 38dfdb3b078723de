"""Exact Jaccard self-join on word shingles: rare-first prefix filter, length, positional and suffix filters, one verification a pair.

1. One pass hashes each text's distinct shingles. Texts of one set form a class, named by the 64-bit hash of the set; the same pass counts
   shingles in a sketch of fixed size.
2. Shingles are ordered rarest first. Blocks of texts deal their shingles to bins, which count each exactly and tell the blocks of those that
   two sets or more hold; only shingles in the sketch's fullest slots are ordered by their slot's count, behind all others. Of n shingles
   the first n - ceil(0.75 n) + 1 are a set's prefix, and of these go to the join those that another set holds.
3. Rows that share a prefix shingle form a list. Emitting all pairs of a list would square a group of copies. As results are components,
   it is enough to find links that join them: in rounds each member of a list is paired with the list's hub, another one in each round, if they
   aren't of one component yet, and of a component's pairs the BEST most promising are verified. Rounds go on while over a
   tenth of their pairs link, and end before if the pairs left to try are no more than the rows of the first lists, or no more than MANY
   times these and a round has taken away less than a quarter of them.
4. The pairs left to try are those in one list whose ends aren't joined yet. These are all tried, so no component is ever missed.
5. A pair passes the length and positional filters in its list, and a short form of the suffix filter, then the suffix filter, which bounds the overlap from the Hamming
   distance of two bitmaps of the whole sets, and is then verified once on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks as B
from .components import components
from .store import discard, materialize

WIDTH, NUM, DEN = 5, 3, 4  # shingles of five words; similarity of NUM/DEN
SKETCH_BITS = 18
BITMAP, FOLD = 32, 8  # words of 64 bits in a set's bitmap, and in the bitmap folded
LOW = 5  # bytes of a shingle that a bin holds
BIN_ROWS = 1 << 21
COMMON = 4096
BEST, HUBS = (2, 6), (4, 64)  # see step 3: pairs of a component that are verified, and hubs that a group of copies gets, in the first round and the later ones
MAX_ROUNDS = 20
MANY = 64
BLOCK = 1 << 20
BROADCAST_ROWS = 1_000_000  # ids of 16 bytes: under 32 MB


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Blocks of rows, and the sorted distinct shingle hashes of each row."""
    for batch in batches:
        for part in B.cut(batch, "text", BLOCK):
            w = B.Words(part.column("text"))
            s, begin = B.shingles(w.hashes(), w.first, width)
            yield part, s, [np.unique(s[begin[i] : begin[i + 1]]) for i in range(part.num_rows)]


def set_name(u: np.ndarray) -> int:
    """64-bit hash of a set of hashes."""
    with np.errstate(over="ignore"):
        a, b = B.mix(u ^ B.U(0x2545F4914F6CDD1D)), B.mix(u + B.U(0x632BE59BD9B4E019))
        x = np.array([a.sum(dtype=B.U) * B.U(3) ^ np.bitwise_xor.reduce(b, initial=B.U(0)) + B.U(len(u))], B.U)
    return int(B.mix(x).view(np.int64)[0])


FACTS = ["doc_id", "text_hash", "name", "n", "bitmap", "slot", "c"]


def bitmaps(sets: list[np.ndarray]) -> pa.Array:
    """A bit for each item at its hash, 64 * BITMAP bits a set."""
    bits = np.zeros((len(sets), 64 * BITMAP), np.uint8)
    for row, u in zip(bits, sets, strict=True):
        row[(B.mix(u) % B.U(64 * BITMAP)).astype(np.int64)] = 1
    flat = np.packbits(bits, axis=1).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BITMAP), pa.array(flat))


def describe(width: int):
    """mapInArrow: doc_id, text_hash -> one row a document with name, n and bitmap; and the task's sketch, as rows with a slot and a count."""

    @B.trimmed
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for part, _, sets in _sets(batches, width):
            if sets:
                sketch += np.bincount((np.concatenate(sets) >> B.U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([set_name(u) for u in sets], pa.int64()), pa.array([len(u) for u in sets], pa.int64()), bitmaps(sets), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], FACTS)
        k = np.flatnonzero(sketch)
        none = pa.nulls(len(k), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(k), pa.list_(pa.int64())), pa.array(k.astype(np.int32)), pa.array(sketch[k])], FACTS)

    return run


PIECE = ["kind", "bin", "block", "ids", "docs", "counts", "names", "sizes"]
PIECES = "kind int, bin int, block long, ids binary, docs binary, counts binary, names binary, sizes binary"


def _piece(kind: int, bin_: int, block: int, **arrays: np.ndarray) -> list:
    return [kind, bin_, block, *[arrays[c].tobytes() if c in arrays else None for c in PIECE[3:]]]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], PIECE)


def _read(x, kind: type) -> np.ndarray:
    return np.frombuffer(x.as_py() or b"", kind)


def to_bins(width: int, bits: int, sketch, common: int):
    """mapInArrow: text -> the shingles of blocks of texts, dealt to 2**bits bins by their first bits; a set comes once a task.

    A shingle's id is the first 40 + bits bits of its hash; a bin's rows hold the last 40 (LOW bytes) and the text's place in its block. Shingles in a slot of over
    common stay with the head of the block, which goes to any one bin and holds the names and sizes of its sets."""

    @B.trimmed
    def run(batches):
        counts, seen = sketch.value, set()
        task, block = TaskContext.get().partitionId() << 32, 0
        for _, _, sets in _sets(batches, width):
            own = []
            for u in sets:
                if len(u) and (name := set_name(u)) not in seen:
                    if len(seen) < 2_000_000:  # 100 MB at most; beyond that a set may come twice, which is harmless
                        seen.add(name)
                    own.append((name, u))
            if not own:
                continue
            sizes = np.array([len(u) for _, u in own], np.int32)
            t, doc = np.concatenate([u for _, u in own]), np.repeat(np.arange(len(own), dtype=np.uint32), sizes)
            often = counts[(t >> B.U(64 - SKETCH_BITS)).astype(np.int64)] > common
            ids = t >> B.U(64 - 8 * LOW - bits)
            at = task | block
            rows = [_piece(1, block % (1 << bits), at, ids=ids[often], docs=doc[often], counts=counts[(t[often] >> B.U(64 - SKETCH_BITS)).astype(np.int64)], names=np.array([n for n, _ in own], np.int64), sizes=sizes)]
            ids, doc = ids[~often], doc[~often]
            order = np.argsort(ids)
            ids, doc = ids[order], doc[order]
            bins, first = np.unique(ids >> B.U(8 * LOW), return_index=True)
            low = ids.view(np.uint8).reshape(-1, 8)[:, :LOW]
            for k, a, e in zip(bins.tolist(), first, [*first[1:], len(ids)], strict=True):
                rows.append(_piece(0, k, at, ids=low[a:e], docs=doc[a:e]))
            block += 1
            yield _batch(rows)

    return run


def count_bin(table: pa.Table) -> pa.Table:
    """applyInArrow, one bin: how many sets hold each shingle; those that two or more hold go back to their blocks."""
    rows = table.combine_chunks().to_batches()
    if not rows:
        return table
    kind, bin_, block, ids, docs = rows[0].columns[:5]
    shingles = np.flatnonzero(kind.to_numpy() == 0)
    raw = np.frombuffer(b"".join(ids[i].as_py() for i in shingles), np.uint8).reshape(-1, LOW)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :LOW] = raw
    x = full.reshape(-1).view(B.U)
    _, where, counts = np.unique(x, return_inverse=True, return_counts=True)
    n = counts[where]
    out, a = [], 0
    for i in shingles.tolist():
        e = a + len(ids[i].as_py()) // LOW
        keep = n[a:e] > 1
        if keep.any():
            out.append(_piece(0, 0, block[i].as_py(), ids=x[a:e][keep] | B.U(bin_[i].as_py() << 8 * LOW), docs=_read(docs[i], np.uint32)[keep], counts=n[a:e][keep]))
        a = e
    B.trim()
    out += [[c[i].as_py() for c in rows[0].columns] for i in np.flatnonzero(kind.to_numpy() == 1).tolist()]
    return pa.Table.from_batches([_batch(out)])


def block_prefixes(table: pa.Table) -> pa.Table:
    """applyInArrow, one block: token, name, np (n << 32 | position) of the prefix shingles that another set holds too.

    Order: shingles of one set alone, then by count and id, then those of common slots by the slot's count and id."""
    rows = table.combine_chunks().to_batches()[0]
    kind = rows.column("kind").to_numpy()
    head = int(np.flatnonzero(kind == 1)[0])
    names, sizes = _read(rows.column("names")[head], np.int64), _read(rows.column("sizes")[head], np.int32).astype(np.int64)
    parts = [*np.flatnonzero(kind == 0).tolist(), head]
    ids, docs, counts = (np.concatenate([_read(rows.column(c)[i], t) for i in parts]) for c, t in (("ids", B.U), ("docs", np.uint32), ("counts", np.int64)))
    last = np.zeros(len(ids), np.int8)
    last[len(ids) - len(_read(rows.column("ids")[head], B.U)) :] = 1
    order = np.lexsort((ids, counts, last, docs))
    ids, docs = ids[order], docs[order].astype(np.int64)
    many = np.bincount(docs, minlength=len(sizes))
    first = np.cumsum(many) - many
    pos = np.arange(len(ids)) - first[docs] + (sizes - many)[docs]
    n = sizes[docs]
    keep = pos < n - (NUM * n + DEN - 1) // DEN + 1
    B.trim()
    return pa.table([B.signed(ids[keep]), pa.array(names[docs[keep]]), pa.array((n[keep] << 32) | pos[keep])], ["token", "name", "np"])


def contents(width: int):
    """mapInArrow: text -> name, items (the whole set)."""

    @B.trimmed
    def run(batches):
        for part, _, sets in _sets(batches, width):
            offs = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int32)
            items = B.signed(np.concatenate(sets)) if part.num_rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([set_name(u) for u in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), items)], ["name", "items"])

    return run


def _n(c: str) -> Column:
    return F.shiftright(c, 32)


def _pos(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))


def _may_link(x: str, y: str) -> Column:
    """Length filter and positional filter.

    Sets that link have NUM/(NUM+DEN) of nx + ny shingles in common at least. The first of these in the order of all shingles has only uncommon ones
    before it, so it stands early enough in both sets to leave that many. A pair that links passes here in the list of that shingle."""
    nx, ny = _n(x), _n(y)
    least = (nx + ny) * NUM
    return (nx * DEN >= ny * NUM) & (ny * DEN >= nx * NUM) & ((nx - _pos(x)) * (NUM + DEN) >= least) & ((ny - _pos(y)) * (NUM + DEN) >= least)


def _suffix_bound() -> Column:
    """Most common shingles that the bitmaps a_map and b_map allow: each bit that differs is a shingle of one set alone."""
    apart = F.expr("aggregate(zip_with(a_map, b_map, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)")
    return F.floor((F.col("na") + F.col("nb") - apart) / 2)


def _sized(table: DataFrame) -> DataFrame:
    """The table, broadcast where its rows, counted first, are few; beyond that its joins shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _open_pairs(lists: DataFrame) -> int:
    """Pairs of rows of one list whose roots differ."""
    per = lists.groupBy("token", "root").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("q"))
    return int(per.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("q")) / 2)).first()[0] or 0)


def _folded() -> Column:
    """The bitmap folded to FOLD words by exclusive or: where two folded ones differ, the bitmaps differ in one bit at least."""
    return F.expr(f"transform(sequence(0, {FOLD - 1}), k -> aggregate(slice(bitmap, k * {BITMAP // FOLD} + 1, {BITMAP // FOLD}), 0L, (s, x) -> s ^ x))")


def _near(x: str, y: str) -> Column:
    """The suffix filter on the folded bitmaps a_fold and b_fold, cheap enough for a join's condition."""
    apart = reduce(Column.__add__, [F.bit_count(F.col("a_fold")[k].bitwiseXOR(F.col("b_fold")[k])) for k in range(FOLD)])
    both = _n(x) + _n(y)
    return (both - apart) * (NUM + DEN) >= both * (2 * NUM)


def _filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, most, and the size, text hash and doc_id (na, ha, da; nb, hb, db) of both ends, of those pairs (a, b) that pass the length and suffix filters; classes: name, n, bitmap, text_hash, rep."""
    one = lambda c: classes.select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"{c}_map"), F.col("text_hash").alias(f"h{c}"), F.col("rep").alias(f"d{c}"))
    x = pairs.join(one("a"), "a").join(one("b"), "b").filter((F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM))
    x = x.withColumn("most", _suffix_bound())
    return x.filter(F.col("most") * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM).drop("a_map", "b_map")


def _verified(pairs: DataFrame, base: DataFrame, width: int) -> DataFrame:
    """a, b of those pairs that link, by the sets themselves, which are made for the texts of these pairs alone. A link may come twice."""
    ends = [pairs.select(F.col(f"h{c}").alias("text_hash"), F.col(f"d{c}").alias("rep")) for c in "ab"]
    texts = materialize(ends[0].unionByName(ends[1]).distinct(), "candidate-texts")
    mine = base.join(_sized(texts), (base["text_hash"] == texts["text_hash"]) & base["doc_id"].eqNullSafe(texts["rep"]), "left_semi")
    sets = materialize(mine.select("text").mapInArrow(contents(width), "name long, items array<bigint>"), "candidate-sets")
    one = lambda c: sets.dropDuplicates(["name"]).select(F.col("name").alias(c), F.col("items").alias(f"{c}_items"))
    both = pairs.select("a", "b", "na", "nb").join(one("b"), "b").join(one("a"), "a")
    common = F.size(F.array_intersect("a_items", "b_items"))
    links = materialize(both.filter(common * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM).select("a", "b"), "links")
    discard(texts, sets)
    return links


def ngram_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, root (names the component; null for empty sets) of every row of docs (doc_id, text).

    A document's set: the distinct width-word shingles of its lower-cased words; with fewer words, the whole sequence; without words or
    text, empty, and linked with nothing (component_id is its own doc_id). Two documents link at a Jaccard similarity of 0.75 or more;
    component_id is the smallest doc_id that links reach. Defined cases: a null doc_id takes part in links but is no smallest id (a component
    of null ids alone gets null); rows that share a doc_id are documents of their own in linking; an empty table gives no rows.
    Sets are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    facts = materialize(base.mapInArrow(describe(width), "doc_id long, text_hash long, name long, n long, bitmap array<bigint>, slot int, c long"), "sets")
    who = facts.filter("slot is null").select("doc_id", "text_hash", "name", "n")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    # At most 2**SKETCH_BITS rows, whatever the input.
    counted = facts.filter("slot is not null").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    sketch[counted["slot"].to_numpy()] = counted["c"].to_numpy()
    shared = spark.sparkContext.broadcast(sketch)
    total = int(sketch.sum())
    # A bin holds some BIN_ROWS shingles; a slot that holds more than 1/COMMON of all is common, so no shingle's rows fill a bin.
    bits = min(24, max(8, math.ceil(math.log2(max(total, 1) / BIN_ROWS))))
    common = max(BIN_ROWS // 64, total // COMMON)
    dealt = base.select("text").mapInArrow(to_bins(width, bits, shared, common), PIECES)
    counted = dealt.groupBy("bin").applyInArrow(count_bin, PIECES)
    rows = materialize(counted.groupBy("block").applyInArrow(block_prefixes, "token long, name long, np long"), "prefixes")
    discard()
    # Rows whose shingle stands in two prefixes or more; partial aggregation meets frequent shingles before the shuffle.
    often = rows.groupBy("token").count().filter("count > 1").select("token")
    lists = materialize(rows.join(often.hint("shuffle_hash"), "token", "left_semi"), "lists")
    discard(rows)
    classes = facts.filter("slot is null").groupBy("name").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min(F.struct("text_hash", "doc_id")).alias("s"))
    classes = materialize(classes.select("name", "n", "bitmap", _folded().alias("fold"), "s.text_hash", F.col("s.doc_id").alias("rep")), "classes")
    discard()
    left, links, known, first, before = lists.withColumn("root", F.col("name")), None, None, lists.count(), math.inf
    for k in range(MAX_ROUNDS):
        later = min(k, 1)
        # The hub of a list is its least name under a mask that depends on the round and, in HUBS ways, on the shingle.
        turn = F.xxhash64(F.lit(k), F.col("token").bitwiseAND(F.lit(HUBS[later] - 1)))
        hubs = left.groupBy("token").agg(F.min(F.col("name").bitwiseXOR(turn)).alias("hub")).select("token", F.col("hub").bitwiseXOR(turn).alias("a"))
        if known is None:
            hubs = hubs.withColumn("ra", F.col("a"))
        else:
            hubs = hubs.join(known.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "left").withColumn("ra", F.coalesce("ra", "a"))
        members = left.select("token", F.col("name").alias("b"), F.col("root").alias("rb"))
        pairs = members.join(hubs.hint("shuffle_hash"), "token").filter("a <> b and ra <> rb").select("a", "b", "ra", "rb").distinct()
        # Each component tries its few best ways out, whether it has the hub or the member.
        tried = materialize(_filtered(pairs, classes), "hub-pairs")
        best = lambda c: F.row_number().over(W.partitionBy(c).orderBy(F.desc(F.col("most") / (F.col("na") + F.col("nb"))), "a", "b"))
        hopeful = reduce(DataFrame.unionByName, [tried.withColumn("r", best(c)).filter(F.col("r") <= BEST[later]) for c in ("ra", "rb")]).select("a", "b", "na", "nb", "ha", "hb", "da", "db").distinct()
        hopeful = materialize(hopeful, "best-pairs")
        new = _verified(hopeful, base, width)
        links = new if links is None else links.unionByName(new)
        known = _sized(components(links))
        # Lists whose members aren't of one component yet go on.
        label = left.drop("root").join(known.withColumnRenamed("v", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
        label = materialize(label, "labelled")
        still = label.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
        rest = materialize(label.join(still.hint("shuffle_hash"), "token", "left_semi"), "open-lists")
        after = _open_pairs(rest)
        over = after <= first or first * MANY >= after > 0.75 * before or new.count() * 10 <= hopeful.count()
        discard(label, tried, hopeful, lists if k == 0 else left)
        left, before = rest, after
        if over:
            break
    # Pairs in a list outnumber those that may link by far, and a pair has many lists: the folded bitmaps hold most of them back inside the join.
    told = left.join(classes.select("name", "fold"), "name")
    one = lambda c: told.select("token", F.col("name").alias(c), F.col("np").alias(f"{c}np"), F.col("root").alias(f"r{c}"), F.col("fold").alias(f"{c}_fold"))
    cross = one("a").join(one("b"), "token").filter((F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & _may_link("anp", "bnp") & _near("anp", "bnp"))
    rest = materialize(_filtered(cross.select("a", "b").distinct(), classes), "other-pairs")
    discard(left)
    root = _sized(components(links.unionByName(_verified(rest, base, width))))

    named = who.join(root.select(F.col("v").alias("name"), "root"), "name", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "name")))
    smallest = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(smallest, "root", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that represent their component: the row of its smallest doc_id (of its smallest text hash where rows share an id).

    Every other column stays as it is. Texts without words are linked with nothing and all stay."""
    found = materialize(ngram_components(docs, width), "components")
    discard()
    alone = found.filter("root is null").select("doc_id", "text_hash")
    first = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "text_hash", "doc_id")).alias("s")).select("s.doc_id", "s.text_hash")
    keep = first.unionByName(alone).distinct().select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"))
    kept = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_semi")
    # Rows alike in id and text are one document told twice: one of them stays. Texts are only shuffled for that if there are such rows.
    once = found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    return kept if once else kept.dropDuplicates(["doc_id", "text"])
