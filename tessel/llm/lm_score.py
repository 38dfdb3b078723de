"""Language-model scores: a unigram model over words with add-one counts (the base), and the marginal likelihood of a subword lattice.

The lattice's vocabulary is that of an existing sentencepiece model; pieces never cross a space, so a text's lattice is the chain of its
words' lattices, and its marginal probability the product over words (each with the word-start sign in front) and of the end piece. Over one
word, the forward recursion in log space sums all segmentations: alpha[e] = logsumexp over pieces that end at e. A piece's weight is its
share among the pieces that the vocabulary's own scores choose for the training words, add-one smoothed; byte pieces can spell anything.

Words are counted over all training texts: each task counts its own first, then one shuffle by word hash adds up. The counts table grows with
the corpus and never leaves the executors, but for the most frequent words, at most HEAD of them, which are broadcast; the counts of
the others reach their documents by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .store import materialize

PARTS, HELD = 7, 2
HEAD = 1 << 17
FLUSH = 1 << 20  # distinct words a task holds before it hands its counts on
CACHE = 1 << 21  # words whose lattice score a worker keeps
LOG10 = math.log(10)
SIGN = "▁".encode()
END = np.array([0xE4D3C2B1A0F9E8D7], B.U)  # the end token's key; words are hashed


class Counter:
    """Adds up counts of 64-bit keys in sorted arrays; where asked, the words' bytes come along."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, B.U), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        self.keys, where = np.unique(both, return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)


def count_words(model_file: str):
    """mapInArrow: text -> rows (kind, key, c): kind 0 words, 1 pieces (key: id), of the training texts given."""

    @B.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = np.zeros(sp.vocab_size(), np.int64)
        total, known, ids, docs = Counter(), {}, [], 0

        def rows(kind, keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), keys, pa.array(counts)], ["kind", "key", "c"])

        for batch in batches:
            for part in B.cut(batch, "text"):
                docs += part.num_rows
                w = B.Words(part.column("text"))
                if not len(w):
                    continue
                keys, at, counts = np.unique(w.hashes(), return_index=True, return_counts=True)
                fresh = [i for i, k in enumerate(keys.tolist()) if k not in known]
                for i, got in zip(fresh, sp.encode([w.text(at[i]).decode("utf-8", "replace") for i in fresh], num_threads=1) if fresh else (), strict=True):
                    known[int(keys[i])] = len(ids)
                    ids.append(np.array(got, np.int32))
                which = [known[k] for k in keys.tolist()]
                flat = [ids[i] for i in which]
                pieces += np.bincount(np.concatenate(flat), np.repeat(counts, [len(x) for x in flat]), len(pieces)).astype(np.int64)
                total.add(keys, counts)
                if len(total.keys) > FLUSH:
                    yield rows(0, B.signed(total.keys), total.counts)
                    total, known, ids = Counter(), {}, []
        total.add(END, np.array([docs]))
        keep = total.counts > 0
        yield rows(0, B.signed(total.keys[keep]), total.counts[keep])
        used = np.flatnonzero(pieces)
        yield rows(1, pa.array(used.astype(np.int64)), pieces[used])

    return run


class Lattice:
    """Log-space forward recursion over many words at once."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray, byte_logs: np.ndarray):
        size = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(size)
        self.longest = int(size.max())
        h = B.span_hashes(data, ends - size, ends)
        order = np.argsort(h)
        self.keys, self.logs, self.byte_logs = h[order], logs[order], byte_logs
        self.sizes = set(size.tolist())

    def words(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word, as it is given."""
        out = np.empty(len(words))
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            # Words of like length together; few at a time if they are long.
            long = int(size[order[i]])
            j = i + 1
            most = max(1, 400_000 // max(long, 1))
            while j < len(order) and j - i < most and size[order[j]] <= long + 2:
                j += 1
            out[order[i:j]] = self._same([words[k] for k in order[i:j]], size[order[i:j]])
            i = j
        return out

    def _same(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        n, longest = len(words), int(size.max())
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        alpha = np.full((longest + 1, n), -np.inf)
        alpha[0] = 0.0
        padded = np.zeros((longest, n), np.uint8)
        col = np.repeat(np.arange(n), size)
        row = np.arange(len(data)) - np.repeat(begin, size)
        padded[row, col] = data
        for end in range(1, longest + 1):
            live = np.flatnonzero(size >= end)
            parts = [alpha[end - 1, live] + self.byte_logs[padded[end - 1, live]]]
            starts = [s for s in range(max(0, end - self.longest), end) if end - s in self.sizes]
            if starts:
                a = (begin[live][None, :] + np.array(starts)[:, None]).ravel()
                e = np.tile(begin[live] + end, len(starts))
                k = np.argsort(a, kind="stable")
                h = np.empty(len(a), B.U)
                h[k] = B.span_hashes(data, a[k], e[k])
                where = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                log = np.where(self.keys[where] == h, self.logs[where], -np.inf).reshape(len(starts), -1)
                parts += list(alpha[np.array(starts)][:, live] + log)
            x = np.stack(parts)
            top = x.max(0)
            alpha[end, live] = top + np.log(np.exp(x - top).sum(0))
        return alpha[size, np.arange(n)]


def make_lattice(model_file: str, counts: dict[int, int], docs: int) -> tuple[Lattice, float]:
    """The lattice of the model's pieces, weighted by counts with add-one smoothing, and the end piece's natural log weight."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = sum(counts.get(i, 0) + 1 for i in ids) + docs + 1
    byte_logs, pieces, logs = np.full(256, -np.inf), [], []
    for i in ids:
        log = math.log((counts.get(i, 0) + 1) / total)
        if sp.is_byte(i):
            byte_logs[int(sp.id_to_piece(i)[3:-1], 16)] = log
        else:
            pieces.append(sp.id_to_piece(i).encode())
            logs.append(log)
    return Lattice(pieces, np.array(logs), byte_logs), math.log((docs + 1) / total)


_KEPT: dict[int, dict[int, float]] = {}


def score_texts(shared, token: int):
    """mapInArrow: doc_id, text -> one row a text, with its frequent words' share of the base score and its other words' keys."""

    @B.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, end, head_keys, head_logs = shared.value
        kept = _KEPT.setdefault(token, {})
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in B.cut(batch, "text"):
                w = B.Words(part.column("text"))
                keys, at, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
                if len(kept) > CACHE:
                    kept.clear()
                fresh = [i for i, k in enumerate(keys.tolist()) if k not in kept]
                if fresh:
                    for i, x in zip(fresh, lattice.words([SIGN + w.text(at[i]) for i in fresh]).tolist(), strict=True):
                        kept[int(keys[i])] = x
                logs = np.array([kept[k] for k in keys.tolist()], float)
                spot = np.minimum(np.searchsorted(head_keys, keys), max(len(head_keys) - 1, 0))
                head = head_keys[spot] == keys if len(head_keys) else np.zeros(len(keys), bool)
                base = np.where(head, head_logs[spot], 0.0) if len(head_keys) else np.zeros(len(keys))
                of = np.repeat(np.arange(part.num_rows), np.diff(w.first))
                edge = lambda x: np.bincount(of, x, part.num_rows)
                score = (edge(logs[where]) + end) / LOG10
                tail = ~head[where]
                count = edge(tail).astype(np.int64)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array((np.arange(row, row + n, dtype=np.int64) | (task << 40))), pa.array(np.diff(w.first) + 1), pa.array(edge(head[where]).astype(np.int64)), pa.array(edge(base[where])), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), B.signed(keys[where][tail]))],
                    ["doc_id", "row", "n_tokens", "head_known", "head_log", "score", "tail"])
                row += n

    return run


def lm_scores(docs: DataFrame, model_file: str, parts: int = PARTS, held: int = HELD, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Training texts are those whose crc32(doc_id as text) mod parts is not held. Tokens are the lower-cased words, then one end token.
    base_score: sum of log10((c + 1) / (N + V + 1)) over tokens; score: log10 of the lattice's marginal probability. Defined cases: a null or
    empty text has the end token alone; a null doc_id isn't held out and trains; repeated rows count each time; with no training text
    every c is 0 and pieces weigh the same; an empty table gives no rows. Words are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = materialize(docs.filter(~held_out).select("text").mapInArrow(count_words(model_file), "kind int, key long, c long"), "counted")
    words = materialize(got.filter("kind = 0").groupBy("key").agg(F.sum("c").alias("c")), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end_key = int(END.view(np.int64)[0])
    pieces = {r.key: r.c for r in got.filter("kind = 1").groupBy("key").agg(F.sum("c").alias("c")).collect()}  # at most one row a piece
    ends = words.filter(F.col("key") == end_key).first()
    n_docs = ends.c if ends else 0
    # The least count of the head: how many words have each count, most first, until HEAD would be passed. Counts over 65535 are one step.
    steps = words.groupBy(F.least("c", F.lit(65536)).alias("s")).count().orderBy(F.desc("s")).collect()
    least, so_far = 65537, 0
    for r in steps:
        if so_far + r["count"] > head:
            break
        least, so_far = r.s, so_far + r["count"]
    top = words.filter((F.col("c") >= least) & (F.col("key") != end_key)).toPandas()  # at most HEAD rows
    top_keys = top["key"].to_numpy(np.int64).view(B.U)
    order = np.argsort(top_keys)
    lattice, end = make_lattice(model_file, pieces, n_docs)
    shared = spark.sparkContext.broadcast((lattice, end, top_keys[order], np.log10(top["c"].to_numpy(float) + 1)[order]))
    scored = materialize(docs.mapInArrow(score_texts(shared, shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast else id(shared)), "doc_id long, row long, n_tokens long, head_known long, head_log double, score double, tail array<bigint>"), "scored")
    # Words under the head's least count meet their counts by a join; partial sums by document come before the second shuffle.
    rare = words.filter(F.col("c") < least)
    tail = scored.select("row", F.explode("tail").alias("key")).join(rare, "key").groupBy("row").agg(F.count(F.lit(1)).alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("s"))
    x = scored.drop("tail").join(tail, "row", "left")
    log_end, size = (math.log10(n_docs + 1) if n_docs else 0.0), math.log10(total.n + total.v + 1)
    return x.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", (F.col("head_known") + F.coalesce("k", F.lit(0)) + (1 if n_docs else 0)).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("s", F.lit(0.0)) + F.lit(log_end) - F.col("n_tokens") * F.lit(size)).alias("base_score"), "score",
    )
