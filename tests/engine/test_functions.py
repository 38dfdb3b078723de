"""Arithmetic and text functions: hand-computed values, plain-code counterparts on random inputs, properties."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessel import catalog
from tessel.functions import numeric, text
from tessel.sources import video


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def family(name):
    v = catalog.FAMILIES[name]
    return {k: F.lit(getattr(v, k)) for k in ("factor", "tps", "tmerge", "min_pixels", "max_pixels", "clamp")}


@pytest.mark.parametrize("total,budget,want", [(10, 5, [0, 2, 4, 6, 9]), (16, 8, [0, 2, 4, 6, 8, 10, 12, 15]), (100, 1, [0]), (5, None, [0, 1, 2, 3, 4]), (7, 0, []), (0, 4, []), (3, 9, [0, 1, 2])])
def test_decode_indices(spark, total, budget, want):
    assert one(spark, numeric.decode_indices(F.lit(total), F.lit(budget))) == want


def test_negative_budget_fails(spark):
    with pytest.raises(Exception, match="negative"):
        one(spark, numeric.decode_indices(F.lit(5), F.lit(-1)))


def test_uniform_conventions_on_all_small_sizes(spark):
    rows = [(n, k) for n in range(1, 40) for k in range(1, 45)]
    df = spark.createDataFrame(rows, "n long, k long")
    for r in df.select("n", "k", numeric.center_indices(F.col("n"), F.col("k")).alias("c"), numeric.hi_indices(F.col("n"), F.col("k")).alias("h")).collect():
        k = min(r.k, r.n)
        assert r.c == (list(range(r.n)) if k == r.n else [min(r.n - 1, int((i + 0.5) * r.n / k)) for i in range(k)])
        assert r.h == ([r.n // 2] if k == 1 else [int((r.n - 1) * i / (k - 1)) for i in range(k)])


@pytest.mark.parametrize("n,k,want", [(128, 8, [0, 18, 36, 54, 72, 90, 108, 127]), (128, 4, [0, 42, 84, 127]), (9, 3, [0, 4, 8]), (128, 1, [64])])
def test_hi_indices(spark, n, k, want):
    assert one(spark, numeric.hi_indices(F.lit(n), F.lit(k))) == want


@pytest.mark.parametrize("h,w,r,want", [(720, 1280, 1.0, (704, 1280)), (720, 1280, 0.5, (352, 640)), (720, 1280, 0.25, (192, 320)), (10, 10, 1.0, (32, 32)), (64, 64, 0.25, (32, 32))])
def test_resize(spark, h, w, r, want):
    assert tuple(one(spark, numeric.resize_side(F.lit(s), F.lit(r), F.lit(32))) for s in (h, w)) == want


@pytest.mark.parametrize("h,w,want", [(360, 640, (352, 640)), (2048, 2048, (864, 864)), (32, 32, (384, 384))])
def test_smart_resize(spark, h, w, want):
    v = catalog.FAMILIES["qwen3_vl"]
    assert tuple(one(spark, c) for c in numeric.smart_resize(F.lit(h), F.lit(w), F.lit(v.factor), F.lit(v.min_pixels), F.lit(v.max_pixels))) == want


def test_smart_resize_refuses_long_shapes(spark):
    with pytest.raises(Exception, match="aspect"):
        one(spark, numeric.smart_resize(F.lit(10), F.lit(5000), F.lit(32), F.lit(1), F.lit(10**9))[0])


@pytest.mark.parametrize("n,h,w,want", [(4, 448, 448, 392), (5, 448, 448, 588), (128, 1080, 1920, 23296), (128, 240, 336, 5120), (2, 100, 100, 64), (4, 720, 1280, 728), (4, 96, 96, 128)])
def test_video_tokens(spark, n, h, w, want):
    assert one(spark, numeric.video_tokens(F.lit(n), F.lit(h), F.lit(w), family("qwen3_vl"))) == want


def test_video_tokens_of_the_flat_clamp(spark):
    v = family("qwen2_5_vl")
    assert one(spark, numeric.video_tokens(F.lit(4), F.lit(448), F.lit(448), v)) == 512


def test_budget_solvers_round_trip(spark):
    rows = [(h, w, t) for h, w in ((224, 224), (360, 640), (720, 1280)) for t in (2000, 10_000, 77_777)]
    df = spark.createDataFrame(rows, "h long, w long, t long")
    for name in catalog.FAMILIES:
        v = family(name)
        x = df.withColumn("n", numeric.max_frames(F.col("t"), F.col("h"), F.col("w"), v)).withColumn("used", numeric.video_tokens(F.col("n"), F.col("h"), F.col("w"), v))
        assert x.filter("used > t").count() == 0
    with pytest.raises(Exception, match="below"):
        one(spark, numeric.max_frames(F.lit(3), F.lit(720), F.lit(1280), family("qwen3_vl")))


@pytest.mark.parametrize("n,want", [(1, 1), (2, 1), (4, 2), (5, 3)])
def test_groups(spark, n, want):
    assert one(spark, numeric.temporal_groups(F.lit(n), F.lit(2))) == want


@pytest.mark.parametrize("pre,ratio,budget,up", [(100, 0.25, None, 25), (100, 0.25, 30, 30), (100, 0.25, 999, 100), (3, 0.1, None, 1), (9, 0.25, 0, 1), (10, 0.25, None, 3)])
def test_keep_counts(spark, pre, ratio, budget, up):
    assert one(spark, numeric.keep_ceil(F.lit(pre), F.lit(ratio), F.lit(budget))) == up
    even = min(max(budget if budget is not None else round(pre * ratio), 1), pre)
    assert one(spark, numeric.keep_even(F.lit(pre), F.lit(ratio), F.lit(budget))) == even


def test_softmax_guard(spark):
    assert one(spark, numeric.softmax_fits(F.lit(16), F.lit(11585))) and not one(spark, numeric.softmax_fits(F.lit(16), F.lit(24576)))


def test_increasing_numbers_and_padding(spark):
    rng = random.Random(1)
    for _ in range(20):
        ts = sorted(rng.random() * 9 for _ in range(rng.randrange(1, 25)))
        fps, want = rng.choice([1.0, 2.0, 7.5]), []
        for t in ts:
            x = round(t * fps)
            want.append(x if not want else max(x, want[-1] + 1))
        assert one(spark, video.mrope(F.array(*map(F.lit, ts)), F.lit(fps))) == want
    assert one(spark, video.pad_last(F.array(F.lit(1), F.lit(5), F.lit(7)), 2)) == [1, 5, 7, 7]
    assert one(spark, video.pad_last(F.array(F.lit(1), F.lit(5)), 2)) == [1, 5]


def plain_choice(t):
    w = re.findall(r"\[\[\s*([A-Za-z])\s*\]\]|\{\{\s*([A-Za-z])\s*\}\}", t or "")
    if w:
        return (w[-1][0] or w[-1][1]).upper()
    t = (t or "").strip().upper()
    m = re.match(r"^\(?\s*([A-Z])\s*[\).:\-\s]", t) or re.fullmatch(r"([A-Z])", t) or re.search(r"\b(?:ANSWER|OPTION|CHOICE)\b[^A-Z]{0,8}([A-Z])\b", t) or re.search(r"\b([A-Z])\b", t)
    return m.group(1) if m else None


def test_choices_against_plain_code(spark):
    rng = random.Random(3)
    bits = ["A", "b", "(C)", "answer", "Answer:", "option", "choice", " ", "  ", ". ", ") ", "-", "is", "é", "Éa", "[[d]]", "{{ a }}", "]]", "x_y", "1", "\n", "I think", "because", "!"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(6))) for _ in range(600)] + [None, "", "The answer is A", "(B)", "C. because A", "[[a]] no {{B}}", "I think so", "answerA B", "ANSWER: 12345678 D"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(text.extract_choice(F.col("t")).alias("x")).collect()]
    assert [(t, g) for t, g in zip(texts, got, strict=True)] == [(t, plain_choice(t)) for t in texts]


@pytest.mark.parametrize("answer,gold,want", [("A", "A", True), ("A", "b", False), ("??", " ", True), ("A", " ", False), ("A", None, None), ("(b) x", " b. so", True)])
def test_scores(spark, answer, gold, want):
    assert one(spark, text.score_mcq(F.lit(answer), F.lit(gold).cast("string"))) is want


def test_prompt_leaves_placeholders_of_the_question(spark):
    got = one(spark, text.build_prompt(F.lit("what is {options}?"), F.array(F.lit("x"), F.lit("{question}"))))
    assert "what is {options}?\nA. x\nB. {question}\nThe best answer is:" in got
    with pytest.raises(Exception, match="26"):
        one(spark, text.build_prompt(F.lit("q"), F.array(*[F.lit(str(i)) for i in range(27)])))


@pytest.mark.parametrize("t,want", [("Question: What is the red car doing?", "red car doing"), ("is the", "is the"), ("", ""), (None, "")])
def test_keywords(spark, t, want):
    assert one(spark, text.keywords(F.lit(t).cast("string"))) == want


def test_thinking(spark):
    a, d, t = text.split_thinking(F.lit("hm hm</think> two words "), F.lit(10), F.lit(True))
    assert (one(spark, a), one(spark, d), one(spark, t)) == ("two words", 2, 8)
    a, d, t = text.split_thinking(F.lit("never closed"), F.lit(10), F.lit(True))
    assert (one(spark, a), one(spark, d), one(spark, t)) == ("never closed", 10, 0)


def test_stamps_and_content(spark):
    df = spark.createDataFrame([(12.3456,), (7.0,), (3599.96,), (0.25,)], "x double")
    assert [r.x for r in df.select(text.one_decimal("x").alias("x")).collect()] == ["12.3", "7.0", "3600.0", "0.2"]
    got = one(spark, text.lohi_content(F.lit("q"), F.array(F.lit("1.0"), F.lit("2.5"))))
    assert [p["type"] for p in got] == ["video", "text", "text", "image", "text", "image", "text"] and got[2]["text"] == "<1.0 seconds>" and got[-1]["text"] == "q" and "following 2 high" in got[1]["text"]


@pytest.mark.parametrize("spec", ["2/2", "a/2", "1", "-1/2", "1/2/3", "１/2", ""])
def test_bad_shards(spec):
    with pytest.raises(ValueError):
        text.parse_shard(spec)


def test_catalogs():
    assert text.parse_shard("1/4") == (1, 4)
    assert len(catalog.SETUPS) == 14 and len(catalog.METHODS) == 10 and catalog.setup(catalog.DEFAULT_SETUP).frame_count == 256
    with pytest.raises(KeyError):
        catalog.setup("none")
    with pytest.raises(KeyError):
        catalog.method("none")
    for mode, on in (("none", True), ("always", False), ("x", None)):
        with pytest.raises(ValueError):
            catalog.check_thinking(mode, on)
    assert catalog.template_kwargs("always", True) == {} and catalog.template_kwargs("hybrid", None) == {"enable_thinking": False}
    assert catalog.prune_parameters("random", {"seed": 3}) == {"keep_ratio": 0.25, "seed": 3}
    for bad in ({"keep_ratio": 0}, {"nope": 1}):
        with pytest.raises(ValueError):
            catalog.prune_parameters("random", bad)
    assert math.isclose(catalog.vision("qwen2.5-vl-7b").factor, 28)


def test_visual_tokens_that_enter_the_model(spark):
    df = spark.createDataFrame([(64, True, None, None), (64, False, None, None), (64, True, 16, None), (64, True, None, 16), (None, True, None, None)], "n long, f boolean, i long, p long").coalesce(1)
    got = df.select(numeric.llm_visual_tokens(F.col("n"), F.col("f"), F.col("i"), F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == [64, 0, 80, 16, 0]


def test_tokens_of_an_answer_by_a_given_count(spark):
    a, d, t = text.split_thinking(F.lit("hm</think> two words"), F.lit(30), F.lit(True), count=lambda c: F.char_length(c).cast("long"))
    assert tuple(spark.range(1).select(a, d, t).first()) == ("two words", 9, 21)
