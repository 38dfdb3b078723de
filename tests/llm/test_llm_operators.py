"""The operators of the training-data pipeline against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import blocks, components, decontam, line_dedup, lm_score, media, mixing, ngram_join, quality, queries, substring, token_count, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(low(t))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Ä É"), (6, "x " * 30000), (None, "a null id"), (7, "same text here"), (7, "same text here"), (8, "\x00 odd \x0b bytes 😀")]


# --- blocks

def test_words_match_the_pattern_and_hashes_follow_words():
    texts = [t for _, t in ODD] + ["A b\nC\rd", "tail ", " head"]
    w = blocks.Words(pa.array(texts))
    assert [int(n) for n in np.diff(w.first)] == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert [w.text(i).decode() for i in range(len(w))] == flat
    seen = {}
    assert all(seen.setdefault(k, x) == x for k, x in zip(w.hashes().tolist(), flat, strict=True)) and len(set(flat)) == len(seen)


def test_blocks_keep_rows_whole_and_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 9, 1, 30, 2)] + [None])], ["text"])
    parts = list(blocks.cut(batch, "text", 10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 10 for p in parts)


def test_shingles_of_short_texts_are_the_whole_sequence():
    w = blocks.Words(pa.array(["a b c d e f", "a b", "", "b a", "a b"]))
    s, begin = blocks.shingles(w.hashes(), w.first, 5)
    assert np.diff(begin).tolist() == [2, 1, 0, 1, 1] and s[2] != s[3] and s[2] == s[4]


# --- 1, mixing

def test_pfair_windows_and_deviation_below_one_block():
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 50, **{f"s{i}": 5 for i in range(10)}}, {"x": 1}):
        total, got = sum(weights.values()), mixing.pfair_period(weights)
        assert [s for _, _, s, _, _ in got] == list(range(total))
        for name, k, slot, release, deadline in got:
            assert release == k * total // weights[name] <= slot < deadline == math.ceil((k + 1) * total / weights[name])
        done = Counter()
        for t, (name, *_) in enumerate(got, 1):
            done[name] += 1
            assert all(abs(done[n] - t * w / total) < 1 for n, w in weights.items())


def test_integer_weights_sum_to_the_period():
    assert mixing.integer_weights({"a": 0.5, "b": 0.25, "c": 0.25}, 8) == {"a": 4, "b": 2, "c": 2}
    assert sum(mixing.integer_weights({str(i): i + 0.1 for i in range(50)}, 16).values()) == 50
    assert mixing.integer_weights({}) == {}
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": 0.0})


def test_mix_holds_the_given_weights_themselves(spark):
    """Shares against the weights asked for, not rounded ones: many light sources, more sources than slots of a period, uneven fractions."""
    cases = [({"hot": 9.5, **{f"s{i}": 0.5 for i in range(19)}}, 1024), ({f"s{i:02}": 1 + i % 2 for i in range(12)}, 4), ({"a": 0.1, "b": 0.7, "c": 2**0.5}, 1024), ({f"s{i:04}": 1 + i % 2 for i in range(1100)}, 1024)]
    for weights, period in cases:
        total = math.fsum(weights.values())
        want = {k: math.ceil(600 * w / total) + 1 for k, w in weights.items()}
        rows = [(i, k) for k, n in want.items() for i in range(n)]
        out = mixing.mix(frame(spark, rows, "doc_id long, source string"), weights, block_rows=1, period=period).collect()
        assert len(out) == len(rows)
        done, out = Counter(), sorted(out, key=lambda r: r.mix_slot)
        for t, r in enumerate(out[:600], 1):
            assert r.mix_slot == t - 1 and r.mix_release <= r.mix_slot < r.mix_deadline
            assert r.mix_release == pytest.approx(math.floor(r.mix_block * total / weights[r.source]), abs=1)
            done[r.source] += 1
            if t % 20 == 0:
                assert all(abs(done[k] - t * w / total) < 1 for k, w in weights.items())


def test_mix_keeps_every_row_in_a_total_order(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", i) for i in range(600)] + [(5, "s0", 5), (5, "s0", 5), (None, None, 1)]
    out = mixing.mix(frame(spark, rows, "doc_id long, source string, mix_slot int"), block_rows=4, period=32).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((a, b) for a, b, _ in rows)
    assert len({(r.mix_slot, r.mix_offset) for r in out}) == len(out)
    blocks_of = {}
    for r in out:
        assert blocks_of.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block) and r.mix_release <= r.mix_slot < r.mix_deadline
    size = Counter((r.source, r.mix_block) for r in out)
    for source in {r.source for r in out}:
        assert sorted(b for s, b in size if s == source) == list(range(sum(s == source for s, _ in size)))
        assert all(n == 4 for (s, b), n in size.items() if s == source and (s, b + 1) in size)


def test_mix_of_named_weights_and_of_nothing(spark):
    out = mixing.mix(frame(spark, [(i, "ab"[i % 2]) for i in range(64)], "doc_id long, source string"), {"a": 3, "b": 1}, block_rows=1, period=4).collect()
    first = sorted(out, key=lambda r: r.mix_slot)[:40]
    for t in range(1, 41):
        assert abs(sum(r.source == "a" for r in first[:t]) - 0.75 * t) < 1
    assert mixing.mix(frame(spark, [], "doc_id long, source string")).count() == 0


# --- 2, lines

def brute_lines(rows, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    where = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            where[low(line.strip(strip))].add(-(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        k = -(2**63) if d is None else d
        kept = [x for x in lines if not (len(y := low(x.strip(strip))) >= min_chars and len(where[y]) >= min_docs and max(where[y]) != k)]
        flags = [not (len(y := low(x.strip(strip))) >= min_chars and len(where[y]) >= min_docs and max(where[y]) != k) for x in lines]
        runs, now = [0], True
        for f in flags:
            if f != now:
                runs, now = [*runs, 0], f
            runs[-1] += 1
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept), " ".join(map(str, runs))))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    pool = [prose(rng, n, 30) for n in (3, 6, 8, 9, 12, 5, 30)] + ["", "  spaced out line of words \t", "SPACED OUT line of words", "ümlaut Ähnlich lange zeile", "a" * 19, "a" * 20]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else prose(rng, 9) for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    rows += [*ODD, (3, rows[0][1]), (None, rows[1][1]), (9, pool[3] + "\n" + pool[3])]
    for hot in (4, 10**9):
        line_dedup.HOT_SHARE, old = hot, line_dedup.HOT_SHARE
        got = line_dedup.line_dedup(frame(spark, rows)).collect()
        line_dedup.HOT_SHARE = old
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text, r.keep_bitmap) for r in got), key=repr) == brute_lines(rows)


def test_hot_lines_take_the_other_path(spark, monkeypatch):
    rows = [(i, f"the very same common line\nown line of document number {i}") for i in range(1500)]
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text, r.keep_bitmap) for r in got) == sorted(brute_lines(rows))


def test_line_dedup_leaves_other_columns_alone(spark):
    out = line_dedup.line_dedup(frame(spark, [(1, "t", 7)], "doc_id long, text string, n_lines int"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_text", "keep_bitmap"] and out.first().n_lines == 1
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


# --- 3, near duplicates

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for a, (d, _) in enumerate(rows):
        if d is not None:
            k = find(a)
            least[k] = d if least[k] is None else min(d, least[k])
    return sorted(((d, len(sets[a]), d if not sets[a] else least[find(a)]) for a, (d, _) in enumerate(rows)), key=repr)


def copies(rng, n, length=80, edits=4):
    base = [f"w{rng.randrange(9000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(9000)}"
        out.append(" ".join(w))
    return out


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    texts = copies(rng, 60) + copies(rng, 9, 30, 2) + copies(rng, 12, 12, 1) + ["a b c"] * 3 + ["A b C", "c b a"] + [prose(rng, 40) for _ in range(20)] + ["the common line that is in all of them " * 2 + prose(rng, 3) for _ in range(25)]
    rng.shuffle(texts)
    rows = [*enumerate(texts, 100), *ODD, (None, texts[0]), (100, texts[5])]
    got = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_components_of_driver_rows_and_of_nothing(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    got = ngram_join.ngram_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


def test_components_with_small_bins_and_common_slots(spark, monkeypatch):
    for name, value in (("BIN_ROWS", 64), ("COMMON", 400), ("BLOCK", 4000), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(15)
    texts = copies(rng, 40) + copies(rng, 8, 12, 1) + ["the common line that is in all of them " * 2 + prose(rng, 3) for _ in range(40)] + [prose(rng, 30, 6) for _ in range(10)]
    rng.shuffle(texts)
    rows = [*enumerate(texts, 100), *ODD]
    got = ngram_join.ngram_components(frame(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_keep_one_leaves_one_row_of_each_group(spark):
    rng = random.Random(6)
    rows = [*enumerate(copies(rng, 10, 200, 1) + [prose(rng, 50) for _ in range(5)]), (50, ""), (51, None), (60, "same"), (60, "same"), (61, "same"), (None, "without an id"), (None, "without an id"), (None, "another without an id")]
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in ngram_join.keep_one(frame(spark, rows)).collect())
    assert kept == [*((False, d) for d in (0, *range(10, 15), 50, 51, 60)), (True, 0), (True, 0)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2050), rng.randrange(2000, 2050)) for _ in range(60)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[v] == min(seen)


def test_components_in_rounds_equal_those_of_one_place(spark, monkeypatch):
    rng = random.Random(17)
    edges = [(i, i + 1) for i in range(-40, 40)] + [(rng.randrange(2**40, 2**40 + 90), rng.randrange(2**40, 2**40 + 90)) for _ in range(70)] + [(7000, 7000), (9000, 8000), (9000, 8000)]
    table = frame(spark, edges, "a long, b long")
    one = sorted(map(tuple, components.components(table).collect()))
    assert components.components(frame(spark, [], "a long, b long")).count() == 0
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    assert one == sorted(map(tuple, components.components(table).collect())) and len(one) == len({v for e in edges for v in e})
    texts = copies(rng, 30) + copies(rng, 8, 12, 1) + [prose(rng, 30, 6) for _ in range(10)]
    got = ngram_join.ngram_components(frame(spark, [*enumerate(texts)])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components([*enumerate(texts)])


def test_folded_bitmaps_lose_no_link_and_hold_back_pairs_far_apart(spark):
    rng = np.random.default_rng(19)
    F, rows, truth = ngram_join.F, [], []
    for k in range(300):
        n, m = int(rng.integers(1, 120)), int(rng.integers(0, 60))
        own = rng.integers(0, 2**63, n + 2 * m, dtype=np.uint64)
        sets = [np.unique(own[: n + m]), np.unique(np.concatenate([own[:n], own[n + m :]]))]
        truth.append(4 * len(np.intersect1d(*sets)) >= 3 * len(np.union1d(*sets)))
        rows.append((k, len(sets[0]) << 32, len(sets[1]) << 32, *ngram_join.bitmaps(sets).to_pylist()))
    table = frame(spark, rows, "k long, anp long, bnp long, a array<long>, b array<long>")
    for c in "ab":
        table = table.withColumn("bitmap", F.col(c)).withColumn(f"{c}_fold", ngram_join._folded())
    near = {r.k for r in table.filter(ngram_join._near("anp", "bnp")).collect()}
    assert {k for k, t in enumerate(truth) if t} <= near and sum(truth) > 20 and len(near) < sum(truth) + 60


def test_components_of_groups_of_near_copies_take_few_tasks(spark):
    rng = random.Random(18)
    rows = [*enumerate([t for _ in range(6) for t in copies(rng, 30, 60, 4)] + copies(rng, 60, 40, 6))]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    context = spark.sparkContext
    context.setJobGroup("near copies", "")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = ngram_join.ngram_components(frame(spark, rows)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        context._jsc.clearJobGroup()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near copies") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    assert 40 < tasks < 2400  # 3,396 when components took rounds of shuffles for any number of links


# --- 4, quality

def test_scores_of_blocks_equal_sparse_dot_products():
    rng = np.random.default_rng(1)
    texts = pa.array([t for _, t in ODD] + ["THE!! CAPS!! HERE!!", "a a a a b"])
    w = rng.normal(size=1 << quality.BITS)
    fast = quality.score_block(texts, w, 0.25)
    slow = [1 / (1 + math.exp(-max(-40, min(40, 0.25 + float(w[i] @ x))))) for i, x in quality.sparse(texts)]
    assert np.allclose(fast, slow, atol=1e-9)
    alone = [quality.score_block(texts.slice(i, 1), w, 0.25)[0] for i in range(len(texts))]
    assert np.allclose(fast, alone, atol=1e-9)


M64 = (1 << 64) - 1


def mix64(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def brute_quality(text, weights, bias):
    """The score of a text by one n-gram after the other, in whole numbers."""
    words_ = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    kind = lambda b: 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b > 127 else 4 if b in b".," else 5
    hashes, shapes = [], []
    for i, w in enumerate(words_):
        hashes.append(mix64(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & M64))
        kinds = [kind(b) for b in w]
        x = (kinds[0] * 6 + kinds[min(1, len(w) - 1)]) * 6 + kinds[-1]
        x = (x * 2 + (1 in kinds and 0 not in kinds)) * 2 + (5 in kinds)
        shapes.append(mix64(x * 4 + (len(w) > 1) * 2 + (i > 0 and words_[i - 1] == w) + 0xA5A5A5A5))
    z = bias
    for view, seq, sizes in ((1, hashes, (1, 2)), (2, shapes, (1, 2, 3))):
        for size in sizes:
            grams = [seq[i : i + size] for i in range(len(seq) - size + 1)]
            for g in grams:
                k = view * 16 + size
                for y in g:
                    k = (k * 0xD6E8FEB86659FD93 + y) & M64
                z += float(weights[mix64(k) >> 64 - quality.BITS]) / len(grams)
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_scores_against_brute_force_in_any_partitioning(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.orderBy("doc_id").collect()]
    rows = [(k, t) for k, t in rows if len(t or "") < 3000][:80]
    rows += [*((k, (t or "")[:200]) for k, t in ODD), *((5000 + i, t) for i, t in enumerate(["ends in a", "Xyz", "b", "Q 7 ends in é", "ends in a", "!", "1", ".", "ends in a"]))]
    model = quality.train(d, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for parts in (1, 5):
        got = quality.score(frame(spark, rows).repartition(parts), model).collect()
        assert sorted((repr(r.doc_id), r.text or "") for r in got) == sorted((repr(k), t or "") for k, t in rows)
        assert all(abs(r.score - brute_quality(r.text, *model)) < 1e-9 for r in got)
        assert len({r.score for r in got if r.text == "ends in a"}) == 1


def test_held_out_accuracy_and_no_peeking(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.classify(d, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    assert {r.doc_id: r.score for r in quality.classify(d, flipped).collect()} == {r.doc_id: r.score for r in got}


def test_quality_without_labels_keeps_all(spark):
    got = quality.classify(frame(spark, ODD), spark.createDataFrame([(2, None)], "doc_id long, quality int")).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.classify(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# --- 5, language model

@pytest.fixture(scope="module")
def small_lattice():
    model = queries.vocabulary(queries.LM_VOCABULARY)
    return lm_score.make_lattice(model, {i: i % 50 for i in range(32000)}, 10)


def test_forward_recursion_sums_all_segmentations(small_lattice):
    lattice, _ = small_lattice
    logs = dict(zip(lattice.keys.tolist(), lattice.logs.tolist(), strict=True))

    def slow(word):
        alpha = [0.0] + [None] * len(word)
        for e in range(1, len(word) + 1):
            total = math.exp(alpha[e - 1] + lattice.byte_logs[word[e - 1]])
            for s in range(max(0, e - lattice.longest), e):
                k = int(blocks.span_hashes(np.frombuffer(word, np.uint8), np.array([s]), np.array([e]))[0])
                total += math.exp(alpha[s] + logs[k]) if k in logs else 0.0
            alpha[e] = math.log(total)
        return alpha[-1]

    some = [lm_score.SIGN + x for x in (b"the", b"thhaen", "équeelle".encode(), "漢字".encode(), b"!!", b"a" * 40, b"b")]
    assert np.allclose(lattice.words(some), [slow(w) for w in some], rtol=1e-9)
    assert np.allclose(lattice.words(some[::-1]), lattice.words(some)[::-1])


def test_lm_base_scores_against_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.collect()][:60] + ODD
    got = lm_score.lm_scores(frame(spark, rows), queries.vocabulary(queries.LM_VOCABULARY), head=50).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter()
    for d, t in rows:
        if not held(d):
            c.update([*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((repr(d), held(d), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), "\n"]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), "\n"]), 4)) for d, t in rows)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.lm_scores(frame(spark, []), queries.vocabulary(queries.LM_VOCABULARY)).count() == 0


def test_lm_scores_against_brute_force(spark, docs):
    """Weights from the corpus, then the sum over all segmentations of every word by a plain recursion."""
    import sentencepiece

    rows = sorted((tuple(r) for r in docs.collect() if len(r.text or "") < 400), key=repr)[:25] + [(900, None), (901, ""), (902, "ünï \x00 😀 xyzzyx"), (903, "x" * 300)]
    path = queries.vocabulary(queries.LM_VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    training = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    used = Counter(i for t in training for w in words(t) for i in sp.encode(w))
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = sum(used[i] + 1 for i in ids) + len(training) + 1
    weight, spelled = {}, {}
    for i in ids:
        if sp.is_byte(i):
            spelled[int(sp.id_to_piece(i)[3:-1], 16)] = (used[i] + 1) / total
        else:
            weight[sp.id_to_piece(i).encode()] = (used[i] + 1) / total
    longest = max(map(len, weight))

    def log_word(w):
        w = "▁".encode() + w.encode()
        logs = [0.0]
        for e in range(1, len(w) + 1):
            terms = [logs[e - 1] + math.log(spelled[w[e - 1]])]
            terms += [logs[s] + math.log(weight[w[s:e]]) for s in range(max(0, e - longest), e) if w[s:e] in weight]
            top = max(terms)
            logs.append(top + math.log(sum(math.exp(x - top) for x in terms)))
        return logs[-1]

    for r in lm_score.lm_scores(frame(spark, rows), path).collect():
        t = dict(rows)[r.doc_id]
        want = (sum(map(log_word, words(t))) + math.log((len(training) + 1) / total)) / math.log(10)
        assert abs(r.score - want) < 1e-6 * max(1, abs(want))


def test_lm_prefers_text_like_its_own(spark, docs):
    got = lm_score.lm_scores(docs, queries.vocabulary(queries.LM_VOCABULARY)).filter("held_out and n_tokens > 20").collect()
    noise = lm_score.lm_scores(docs.unionByName(frame(spark, [(10**9 + i, "zq xv kj qqz vxq jjk wqx " * 5) for i in range(30)])), queries.vocabulary(queries.LM_VOCABULARY)).filter(f"doc_id >= {10**9} and held_out").collect()
    assert noise and max(r.score / r.n_tokens for r in noise) < sorted(r.score / r.n_tokens for r in got)[len(got) // 4]


# --- 6, media

def test_wav_round_trip_and_columns(spark):
    rows = [*ODD, (20, "x" * 576), (21, "x" * 577), (22, "y" * 70000)]
    out = media.media_columns(frame(spark, rows)).collect()
    by = defaultdict(list)
    for r in out:
        by[r.text].append(r)
    for _, t in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        wav, n = media.to_wav(data)
        assert media.from_wav(wav) == payload and n == len(payload)
        for r in by[t]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.tail_crc32, bytes(r.media)) == (zlib.crc32(payload[-32:]), wav)
            assert r.feature == by[t][0].feature and len(r.peak_times) == len(r.peak_codes)
    assert media.media_columns(frame(spark, [])).count() == 0


def brute_fingerprint(payload):
    """Peaks and their pairs from sums of cosines and sines."""
    n, hop = media.FRAME, media.HOP
    frames = -(-len(payload) // hop)
    x = np.full(frames * hop + n, 128.0)
    x[: len(payload)] = np.frombuffer(payload, np.uint8)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    found = []
    for f in range(frames):
        mag = np.abs(turn @ ((x[f * hop : f * hop + n] - 128) * window))
        found.append([lo + int(np.argmax(mag[lo:hi])) if mag[lo:hi].max() > 2 * mag[lo:hi].mean() else -1 for lo, hi in media.BANDS])
    return sorted((f, p << 13 | q << 4 | step) for f in range(frames) for step in (1, 2, 3) if f + step < frames for p in found[f] for q in found[f + step] if p >= 0 and q >= 0)


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(1, prose(rng, 300)), (2, "la " * 700), (3, ""), (4, "é" * 600), (5, None)]
    for r in media.media_columns(frame(spark, rows)).collect():
        data = (r.text or "").encode()
        want = brute_fingerprint(data + b"\xff" * (-len(data) % 576 if data else 576))
        assert list(zip(r.peak_times, r.peak_codes, strict=True)) == want
        t, c = np.array([x for x, _ in want], np.int32), np.array([x for _, x in want], np.int32)
        assert r.feature.endswith(f":{len(want)}:{zlib.crc32(c.tobytes(), zlib.crc32(t.tobytes())):08x}")


def test_peaks_find_a_tone_and_chunks_dont_matter(monkeypatch):
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE)).astype(np.uint8)
    p = media.peaks(tone)
    assert (p[:28, 2] == 64).all()  # 1000 Hz at 8000 / 512 Hz a bin
    monkeypatch.setattr(media, "CHUNK", 3)
    assert (media.peaks(tone) == p).all()
    times, codes = media.fingerprint(tone)
    assert (np.diff(times) >= 0).all() and set(codes & 15) <= {1, 2, 3}


# --- 7, urls

def brute_url(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = low(m[1]), m[2]
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h) or not h) and path.startswith("/" + p):
            key = (len(h.split(".")) if h else 0, len(p), verdict == "allow")
            best = max(best or (key, rule, verdict), (key, rule, verdict))
    return host, path, best and best[1], best[2] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(8)
    rules = [*url_filter.RULES, ("block", "a.b.example.org/"), ("allow", "example.org/es/7"), ("block", "org/x/y"), ("allow", "org/x/y/z/"), ("block", "com/"), ("allow", "com/de/ok")]
    hosts = ["x.example.org", "example.org", "EXAMPLE.ORG", "notexample.org", "a.b.example.org", "com", "q.com", "q.com:80", "", "net", "a..org", "org"]
    paths = ["", "/", "/es", "/es/", "/es/70", "/en/1", "/en/17/x", "/fr/a", "/de/", "/de/okay", "/x/y", "/x/yy/z", "/x/y/z/", "//", "/EN/1"]
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', '://', ':/'])}{h}{p}{rng.choice(['', '?a=http://z.org/', '#f', '?'])}" for h in hosts for p in paths] + [None, "", "org/", "a\nb://x.org/y", "http://u@x.org/a://b"]
    got = url_filter.judge(spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string"), rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute_url(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError):
        url_filter.Trie([("maybe", "a/")])


# --- 8, decontamination

def brute_leaks(rows, items, threshold=0.75):
    out = {}
    for d, t in rows:
        w = words(t)
        for i, x in items:
            b = words(x)
            if len(b) < 5:
                continue
            for start in range(-len(b), len(w)):
                n = sum(0 <= start + k < len(w) and w[start + k] == y for k, y in enumerate(b))
                if n >= threshold * len(b):
                    out[d, i] = max(out.get((d, i), 0), n)
    return out


def test_masks_find_every_choice_of_replaced_words():
    for n in range(decontam.MIN_WORDS, 25):
        placed = [sum(1 << at + k for k in mask) for mask, least, most in decontam.MASKS if least <= n <= most for at in range(n - mask[-1])]
        for gone in itertools.combinations(range(n), n // 4):
            bits = sum(1 << k for k in gone)
            assert any(not p & bits for p in placed), (n, gone)


def test_leaks_with_substitutions_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(5, 40), 3000)) for i in range(12)] + [(50, "too few words"), (51, None), (52, "One Two Three Four Five"), (0, "another text under the same number of item")]
    rows = [*ODD]
    for d in range(100, 160):
        body = prose(rng, rng.randrange(0, 60), 3000).split()
        w = words(items[d % 12][1])
        for _ in range(rng.randrange(0, 1 + len(w) // 4)):
            w[rng.randrange(len(w))] = "other"
        at = rng.randrange(len(body) + 1)
        rows.append((d, " ".join([*body[:at], *w, *body[at:]])))
    rows += [(200, "so ONE two\tthree four five six"), (201, "one two three four")]
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontam.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(rows, items)
    assert got == want
    clean = decontam.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(r.doc_id for r in clean) == Counter(d for d, _ in rows if not any(k[0] == d for k in got))


def test_leaks_in_upper_case_and_with_punctuation(spark):
    item = "où l'élève étudiait près de la forêt l'été passé, straße über öl äpfel (ñandú) año – где живёт ёж και η οδός"
    whole = len(item.split())
    rows = [(1, f"Avant {item.upper()}!! après"), (2, f"«{item}»"), (3, " ".join(f'"{w}";' if w != "–" else w for w in item.split())), (4, "- -- ?! ... " * 20), (5, item.replace("é", "e"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.start, r.n_words, r.n_equal) for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert {k: got.get(k) for k in (1, 2, 3)} == {1: (1, whole, whole), 2: (0, whole, whole), 3: (0, whole, whole)} and 4 not in got
    assert {r.doc_id for r in decontam.decontaminate(frame(spark, rows), bench).collect()} == {1, 2, 3, 4, 5} - set(got)


def test_leaks_shuffled_and_of_nothing(spark, monkeypatch):
    items, rows = [(1, "alpha beta gamma delta epsilon zeta eta theta")], [(1, "x alpha beta gamma delta epsilon zeta eta theta y"), (2, "alpha beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_HITS", 0)
    assert [(r.doc_id, r.start, r.n_equal) for r in decontam.leaks(frame(spark, rows), bench).collect()] == [(1, 1, 8)]
    assert decontam.leaks(frame(spark, []), bench).count() == 0
    assert decontam.leaks(frame(spark, rows), bench.limit(0)).count() == 0


# --- 9, substrings

def test_windows_stand_for_every_subsequence():
    rng = random.Random(3)
    for n in (1, 7, 40, 90):
        h = np.array([rng.getrandbits(5) for _ in range(n)], np.uint64)
        for span in (1, 4, 13):
            got = substring.windows(h, span)
            for i in range(n):
                for j in range(i + span - 1, n):
                    c = min(range(i, j + 1), key=lambda k: (h[k], k))
                    assert sum(l <= i <= w <= j <= r and w == c for w, l, r in got) == 1


def test_repeated_passages_are_found_and_others_not(spark):
    rng = random.Random(4)
    shared = [prose(rng, n, 10**6) for n in (60, 75, 120)]
    rows = [(1000 + i, " ".join([prose(rng, rng.randrange(5, 90), 10**6), shared[i % 3], prose(rng, rng.randrange(0, 90), 10**6)])) for i in range(45)]
    rows += [(100 + i, prose(rng, 150, 10**6)) for i in range(10)] + [(200, " ".join([prose(rng, 20, 10**6), " ".join(shared[1].split()[:30])]))]
    rows += [(300, "equal " + prose(rng, 60, 10**6))] + ODD
    rows += [(301, rows[-11][1]), (301, rows[-11][1]), (None, rows[-11][1])]
    got = substring.repeated_passages(frame(spark, rows)).collect()
    by = dict((d, words(t)) for d, t in rows if d is not None)
    linked = {r.doc_id for r in got} | {r.other_id for r in got}
    assert linked == {*range(1000, 1045), 300, 301, None}
    for r in got:
        assert r.end - r.start >= 50 and r.similarity >= 0.75
        if None not in (r.doc_id, r.other_id) and r.similarity == 1:
            assert by[r.doc_id][r.start : r.end] == by[r.other_id][r.other_start : r.other_end]
    assert substring.repeated_passages(frame(spark, [])).count() == 0


def test_passages_of_lines_that_other_documents_hold_alone(spark):
    rng = random.Random(19)
    rows, holders = [], []
    for g in range(20):
        lines = [prose(rng, 20, 10**6) for _ in range(3)]
        holders.append(set(range(len(rows), len(rows) + 3)))
        for body in [*["\n".join(lines)] * 3, *[line for line in lines for _ in range(20)]]:
            rows.append((len(rows), f"{prose(rng, rng.randrange(40, 90), 10**6)}\n{body}\n{prose(rng, rng.randrange(40, 90), 10**6)}"))
    got = substring.repeated_passages(frame(spark, rows)).collect()
    where = dict(rows)
    assert all({r.doc_id, r.other_id} in [{a, b} for a in h for b in h] for r in got for h in holders if r.doc_id in h)
    for h in holders:
        links = {frozenset((r.doc_id, r.other_id)) for r in got if r.doc_id in h}
        assert set().union(*links) == h and len(links) >= 2, "a holder without a link"
    for r in got:
        a, b = words(where[r.doc_id])[r.start : r.end], words(where[r.other_id])[r.other_start : r.other_end]
        assert a == b and len(a) >= 50


def test_a_passage_beside_the_first_window_of_the_lead(spark):
    """The least shingles stand in two places of each text: in a line alone, and in the passage."""
    rng, rows = random.Random(23), []
    for i in range(0, 60, 2):
        line, tail = prose(rng, 45, 10**6), prose(rng, 10, 10**6)
        rows += [(i + k, "\n".join([line, prose(rng, 80, 10**6), line, tail, prose(rng, 60, 10**6)])) for k in range(2)]
    got = substring.repeated_passages(frame(spark, rows)).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == {frozenset((i, i + 1)) for i in range(0, 60, 2)}


def test_no_similar_passage_is_left_out(spark):
    """Passages with words replaced, left out or put in, beside texts that hold a half of them; passages that come again in a text, after another text has them."""
    rng, rows, want, twice = random.Random(29), [], [], []

    def sets(t):
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    def add(*parts):
        rows.append((len(rows), " ".join([prose(rng, rng.randrange(5, 120), 10**6), *(" ".join(p) for p in parts), prose(rng, rng.randrange(5, 120), 10**6)])))
        return rows[-1][0]

    while len(want) < 80:
        one = prose(rng, rng.choice([50, 54, 60, 80, 120]), 10**6).split()
        other = list(one)
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(5, len(other) - 5)
            other[k : k + rng.randrange(2)] = prose(rng, rng.randrange(2), 10**6).split()
        x, y = sets(one), sets(other)
        if len(other) < 50 or len(x & y) < 0.75 * len(x | y):
            continue
        want.append((add(one), add(other)))
        for _ in range(rng.randrange(3)):
            add(one[: len(one) // 2 + 10])
    for _ in range(10):
        one = prose(rng, 60, 10**6).split()
        add(one)
        twice.append(add(one, prose(rng, 70, 10**6).split(), one))
    got = substring.repeated_passages(frame(spark, rows)).collect()
    links = {(r.doc_id, r.other_id) for r in got} | {(r.other_id, r.doc_id) for r in got}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)

    def linked(a, b):  # by a chain, as through a text with the half that both have
        seen, new = {a}, {a}
        while new := {y for x in new for y in near[x]} - seen:
            seen |= new
        return b in seen

    assert all(linked(a, b) for a, b in want) and all((d, d) in links for d in twice)


def test_pairs_of_texts_are_verified_in_bounded_parts(spark, monkeypatch):
    """Passages whose thirds stand in other texts, so that their windows have several hubs, and lines that many texts hold."""
    rng, rows, want = random.Random(31), [], []

    def add(part):
        rows.append((len(rows), " ".join([prose(rng, rng.randrange(10, 60), 10**6), part, prose(rng, rng.randrange(10, 60), 10**6)])))
        return rows[-1][0]

    for _ in range(10):
        one = prose(rng, 66, 10**6).split()
        want.append({add(" ".join(one)), add(" ".join(one))})
        for k in range(0, 66, 22):
            add(" ".join(one[k : k + 22]))
    line = prose(rng, 44, 10**6)
    for _ in range(12):
        add(line)
    made, keep = [], substring.materialize

    def noted(df, name):
        made.append((name, out := keep(df, name)))
        if name == "regions":
            made[-1] = (name, out.count())
        return out

    monkeypatch.setattr(substring, "materialize", noted)
    monkeypatch.setattr(substring, "PAIRS", 0.5, raising=False)
    got = substring.repeated_passages(frame(spark, rows)).collect()
    links = {frozenset((r.doc_id, r.other_id)) for r in got}
    assert links == {frozenset(x) for x in want}
    assert max(n for name, n in made if name == "regions") <= 0.7 * len(rows)


def test_runs_of_one_word_are_linked_without_all_pairs(spark, monkeypatch):
    """Runs of other lengths, in which a window stands at every place, and copies of texts, whose windows come once."""
    rng, made, keep = random.Random(37), [], substring.materialize
    rows = [(i, " ".join([prose(rng, 30, 10**6), *["again"] * (60 + 40 * i), prose(rng, 30, 10**6)])) for i in range(14)]
    rows += [(100 + i, "copy " + prose(random.Random(i // 2), 80, 10**6)) for i in range(20)]

    def noted(df, name):
        made.append((name, out := keep(df, name)))
        if name in ("regions", "signatures"):
            made[-1] = (name, [r.doc for r in out.select("doc").collect()], [] if name == "signatures" else [r.other for r in out.select("other").collect()])
        return out

    monkeypatch.setattr(substring, "materialize", noted)
    got = substring.repeated_passages(frame(spark, rows)).collect()
    links = {frozenset((r.doc_id, r.other_id)) for r in got if r.doc_id < 100 and r.doc_id != r.other_id}
    part = {0}
    while more := {x for pair in links if pair & part for x in pair} - part:
        part |= more
    assert part == set(range(14))
    assert {(r.doc_id, r.other_id) for r in got if r.doc_id >= 100} == {(101 + i, 100 + i) for i in range(0, 20, 2)}
    assert [len(x[1]) for x in made if x[0] == "signatures"] == [14]
    assert sum(a != b for x in made if x[0] == "regions" for a, b in zip(x[1], x[2], strict=True)) <= 2 * 14


# --- 10, token counts

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    path = queries.vocabulary(queries.COUNT_VOCABULARY)
    return Tokenizer.from_file(path), path


def test_token_counts_equal_the_library(spark, docs, tokenizer):
    tok, path = tokenizer
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "ve", "r", "l", "e", "a", "é", "1", "½", "!", "。", "<|endoftext|>", "\u00a0", "\u3000", "x", "'t", "\u0301", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(300)]
    rows = [tuple(r) for r in docs.collect()][:40] + ODD + list(enumerate(texts, 1000))
    got = token_count.token_counts(frame(spark, [(*r, 0) for r in rows], "doc_id long, text string, n_tokens int"), path).collect()
    want = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_count.token_counts(frame(spark, []), path).count() == 0


def test_merge_transducer_equals_the_library_on_any_bytes(tokenizer):
    counts = token_count.Counts(queries.vocabulary(queries.COUNT_VOCABULARY))
    rng, byte_of = random.Random(21), {int(x): b for b, x in enumerate(token_count._ALPHABET.tolist())}
    pieces = [bytes(byte_of[ord(c)] for c in t) for t in tokenizer[0].get_vocab() if all(ord(c) in byte_of for c in t)]
    samples = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    samples += ["".join(rng.choice("etaoinshrdlu ") for _ in range(rng.randrange(1, 40))).encode() for _ in range(600)]
    samples += [rng.choice([b"a", b" ", b"-", b"ab", b"=", b"the", b"0", b"aab"]) * rng.randrange(1, 150) for _ in range(300)]
    samples += [b"".join(rng.choices(pieces, k=4)) for _ in range(1200)] + [b"etaoin" * 20_000]
    for x in samples:
        seen = token_count._ALPHABET[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le")
        assert counts.merges.count(x) == len(counts.tok.model.tokenize(seen)), x


def test_transitions_may_be_forgotten_at_any_place(monkeypatch):
    counts = token_count.Counts(queries.vocabulary(queries.COUNT_VOCABULARY))
    text = "Transitions are compiled as they are met, and forgotten: élan, 12345, x_y_z. " * 3
    whole = counts.merges.count(text.encode())
    monkeypatch.setattr(token_count, "TRANSITIONS", 5)
    assert counts.merges.count(text.encode()) == whole


def test_prefix_scan_of_state_maps():
    rng = np.random.default_rng(2)
    c = rng.integers(0, 11, 5000).astype(np.uint8)
    resets = rng.random(5000) < 0.01
    state, want = token_count.START, []
    for k, r in zip(c, resets, strict=True):
        state = token_count.START if r else state
        want.append(token_count.EMIT[k, state])
        state = token_count.TO[k, state]
    want = np.array(want)
    begins = (want & 1) != 0
    begins[:-1] |= (want[1:] & 2) != 0
    begins[np.flatnonzero(want & 4) - 1] = False
    assert (token_count.cuts(c, resets) == begins).all()


# --- the contract and the pipeline

CONTRACT = {
    "op2_": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op3_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7_": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10_": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.mark.parametrize("prefix", CONTRACT)
def test_contract_columns(spark, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    got = dict(queries.QUERIES[name](spark, SF).dtypes)
    assert CONTRACT[prefix].items() <= got.items()


def test_pipeline_stages(spark):
    import corpus_pipeline

    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    docs = before
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF).cache()
        if k < 4:
            assert after.columns == columns and dict(after.dtypes) == dict(before.dtypes)
        a, b = docs.collect(), after.collect()
        if k == 0:
            ids = {r.doc_id for r in b}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum((r.doc_id in ids) == labels[r.doc_id] for r in a if r.doc_id in labels) >= 0.95 * sum(r.doc_id in labels for r in a)
        if k == 1:
            assert sorted((r.doc_id, r.text) for r in b) == sorted((d, t) for d, _, _, t, _ in brute_lines([(r.doc_id, r.text) for r in a]))
        if k == 2:
            assert {r.doc_id for r in b} == {c if n else d for d, n, c in brute_components([(r.doc_id, r.text) for r in a])} and len(b) == len({r.doc_id for r in b})
        if k == 3:
            bad = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in a], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
            assert {r.doc_id for r in b} == {r.doc_id for r in a} - bad
        if k == 4:
            assert sorted(r.doc_id for r in b) == sorted(r.doc_id for r in a) and len({(r.mix_slot, r.mix_offset) for r in b}) == len(b)
        docs = after
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
