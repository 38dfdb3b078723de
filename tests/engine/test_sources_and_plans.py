"""Sources and sinks on real files, the dry run of every method, the stream, and the registered queries against DuckDB."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessel import catalog
from tessel.operators import selection
from tessel.plans import oracle, pipeline, queries, registry
from tessel.sources import qa, results, tasks, video
from tessel.streaming import ledger

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def record(i, **more):
    return {"video_id": f"v{i}", "question": "q?", "options": ["first", "second"], "answer": "A"} | more


def test_jsonl_scan(spark, tmp_path):
    df = qa.read(spark, lines(tmp_path / "a.jsonl", [record(0), "", record(1, question_id="q", extra=1)]))
    assert [(r.key, r.options) for r in df.orderBy("ord").collect()] == [("v0", ["first", "second"]), ("q", ["first", "second"])]
    for bad, why in (('{"video_id": ', "line 2"), ("[1]", "line 2"), (json.dumps({"video_id": "x"}), "required")):
        with pytest.raises(Exception, match=why):
            qa.read(spark, lines(tmp_path / "b.jsonl", [record(0), bad])).collect()
    with pytest.raises(Exception, match="duplicate"):
        qa.read(spark, lines(tmp_path / "c.jsonl", [record(0), record(0)])).collect()
    spark.createDataFrame([("v", "q", ["a"], "A")], "video_id string, question string, options array<string>, answer string").write.parquet(str(tmp_path / "d.parquet"))
    assert qa.read(spark, str(tmp_path / "d.parquet")).first().key == "v"


def test_videos_and_subtitles(spark, tmp_path):
    (tmp_path / "videos").mkdir()
    for n in ("v0.mkv", "v0.mp4", "v1.webm", "v1.txt"):
        (tmp_path / "videos" / n).write_bytes(b"x")
    (tmp_path / "subs").mkdir()
    (tmp_path / "subs" / "v0.srt").write_text("one\ntwo")
    df = qa.read(spark, lines(tmp_path / "a.jsonl", [record(0, subtitle_path="v0.srt"), record(1)]))
    listing = qa.files(spark, str(tmp_path / "videos"))
    got = {r.video_id: r for r in qa.with_subtitles(spark, qa.with_videos(df, listing), str(tmp_path / "subs")).collect()}
    assert got["v0"].video_path.endswith("v0.mp4") and got["v1"].video_path.endswith("v1.webm") and got["v0"].subtitles == "one\ntwo" and got["v1"].subtitles is None
    with pytest.raises(Exception, match="no video file"):
        qa.with_videos(df.withColumn("video_id", F.lit("other")), listing).collect()
    with pytest.raises(Exception, match="missing subtitles"):
        qa.with_subtitles(spark, df.withColumn("subtitle_path", F.lit("none.srt")), str(tmp_path / "subs")).collect()
    assert {r.video_id for r in qa.missing_videos(df, listing).collect()} == {"v1"}


def test_write_and_read_shards(spark, tmp_path):
    s = spark.createDataFrame([(0, "v0", None, "A", "A", True, None, "ok", None, 64), (1, "v1", "q1", "", "B", None, None, "error", "E: x", 0)], "ord long, video_id string, question_id string, prediction string, gold string, correct boolean, arm string, status string, error string, prefill_tokens long")
    meta = {"task": "t", "method": "m", "setup": "s", "model": "x", "shard": {"index": 0, "n": 2}}
    run = results.write(s, str(tmp_path), meta)
    assert "t_m_s_s0of2_" in run and not os.path.exists(f"{run}/rounds_trace.jsonl")
    text = [json.loads(x) for f in sorted(os.listdir(f"{run}/results.jsonl")) if f.startswith("part") for x in open(f"{run}/results.jsonl/{f}")]
    assert text[0]["question_id"] is None and text[1]["error"] == "E: x" and list(text[0])[:3] == ["video_id", "question_id", "prediction"]
    summary = json.loads(spark.read.text(f"{run}/summary.json").first().value)
    assert summary["n"] == 2 and summary["errors"] == 1 and summary["accuracy"] == 1.0 and summary["cost_means"]["prefill_tokens"] == 32
    rows, runs = results.read_shards(spark, results.glob(spark, [str(tmp_path / "t_m_s_*")]))
    assert rows[0].count() == 2 and runs.first().model == "x"
    with pytest.raises(FileNotFoundError):
        results.glob(spark, [str(tmp_path / "none*")])
    traced = s.withColumn("rounds_trace", F.array(F.lit("{}")))
    assert os.path.exists(results.write(traced, str(tmp_path / "t"), {k: v for k, v in meta.items() if k != "shard"}) + "/rounds_trace.jsonl")


def test_tasks(tmp_path, monkeypatch):
    monkeypatch.setenv("ROOT_OF_DATA", "/data")
    ok = "task: t\nmetric: mcq_accuracy\ndataset: {loader: 'tessel.sources.qa:read', kwargs: {qa_path: '${ROOT_OF_DATA}/qa.jsonl'}}\ndoc_to_text: '{question}'\n"
    (tmp_path / "t.yaml").write_text(ok)
    t = tasks.load(str(tmp_path / "t.yaml"))
    assert t.kwargs["qa_path"] == "/data/qa.jsonl" and tasks.loader(t.loader) is qa.read and tasks.available(str(tmp_path)) == ["t"]
    for bad in (ok.replace("mcq_accuracy", "bleu"), ok.replace("loader", "other"), ok.replace("'{question}'", "' '"), "- 1\n"):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(ValueError):
            tasks.load(str(tmp_path / "b.yaml"))
    with pytest.raises(FileNotFoundError):
        tasks.load(str(tmp_path / "none.yaml"))


def test_decode_plan_and_codec(spark):
    v = spark.createDataFrame([("v", 720, 1280, 25.0, 100, b"file")], "video_id string, native_h int, native_w int, native_fps double, total_frames long, content binary")
    plan = video.decode_plan(v, catalog.Budget(decode_budget=5, resolution=0.25))
    r = plan.first()
    assert (r.indices, r.height, r.width, r.fps) == ([0, 24, 49, 74, 99], 192, 320, 1.25)
    assert [x.ts for x in video.frames(plan).orderBy("place").collect()] == [i / 25 for i in r.indices]
    got = video.decode(plan, lambda data, ids, h, w: [data + bytes([i]) for i in ids]).orderBy("place").collect()
    assert [bytes(x.payload) for x in got] == [b"file" + bytes([i]) for i in r.indices]
    with pytest.raises(Exception, match="frame rate"):
        video.decode_plan(v.withColumn("native_fps", F.lit(0.0)), catalog.Budget()).collect()


def test_bad_videos_become_rows_of_their_own(spark):
    shape = "video_id string, native_h int, native_w int, native_fps double, total_frames long, content binary"
    v = spark.createDataFrame([("good", 720, 1280, 25.0, 100, b"file"), ("still", 720, 1280, 0.0, 100, b"file"), ("unknown", 720, 1280, None, 100, b"file"), ("broken", 720, 1280, 25.0, 100, b"bad"), ("short", 720, 1280, 25.0, 100, b"few")], shape)
    plan = video.decode_plan(v, catalog.Budget(decode_budget=2), keep_errors=True)

    def codec(data, ids, h, w):
        if data == b"bad":
            raise OSError("no such stream")
        return [data] * (1 if data == b"few" else len(ids))

    got = sorted((r.video_id, r.place, r.error) for r in video.decode(plan, codec, keep_errors=True).collect() if r.place is None or r.payload == b"file")
    rate = f"ValueError: {video.RATE_ERROR}"
    assert got == [("broken", None, "OSError: no such stream"), ("good", 0, None), ("good", 1, None), ("short", None, "ValueError: 1 payloads for 2 frames"), ("still", None, rate), ("unknown", None, rate)]
    with pytest.raises(Exception, match="no such stream"):
        video.decode(video.decode_plan(v.filter("video_id = 'broken'"), catalog.Budget(decode_budget=2)), codec).collect()


def test_samples_whose_scores_do_not_cover_their_pool(spark):
    pools = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 0), (5, None)], "sample long, total long")
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.5)], "sample long, idx long, score double")
    got = {r.sample: r.score_error for r in selection.coverage_errors(scores, pools).collect()}
    assert got == {2: "ValueError: 1 scores for 2 frames", 3: "ValueError: 0 scores for 1 frames", 5: "ValueError: a pool of unknown size"}


def samples(spark, n=3):
    return spark.createDataFrame([(i, f"question {i}", "AB"[i % 2]) for i in range(n)], "sample long, query string, gold string")


def test_dry_run_of_every_method(spark):
    df = samples(spark)
    for m, (select, pruner) in catalog.METHODS.items():
        for s in ("model_default_16f", "lohi_128f_r25_k8"):
            rows = pipeline.dry_run(df, m, s).collect()
            fails = (select.startswith("lohi") and s == "model_default_16f") or pruner in ("mmtok", "visionzip", "flashvid")
            assert len(rows) == 3 and {r.status for r in rows} == {"error" if fails else "ok"}
            if fails:
                assert all(r.correct is None and r.prefill_tokens == 0 and r.error for r in rows)
            else:
                k = rows[0].frames_encoded
                keep = -(-k * 64 // 4) if pruner == "random" else k * 64
                assert all(r.frames_decoded == 64 and r.vit_patch_tokens == k * 256 and r.prefill_tokens == keep and r.rounds == 0 for r in rows)
                assert k == (72 if select.startswith("lohi") and "lohi" in s else 16 if s == "model_default_16f" else 64)
    assert pipeline.dry_run(df, "random-prune", "lowres_base_64f").first().prefill_tokens == 1024
    with pytest.raises(ValueError):
        pipeline.dry_run(df, "aks", "native_16f", model="none")


def test_registry():
    assert {"uniform", "aks", "semdiv"} <= set(registry.available("select"))
    with pytest.raises(ValueError):
        registry.register("select", "uniform")(lambda x: x)
    with pytest.raises(ValueError):
        registry.register("nothing", "x")
    with pytest.raises(KeyError):
        registry.get("select", "none")


def test_stream_of_results(spark, tmp_path):
    schema = "key string, ts timestamp, status string, correct boolean"
    for rows in ([("a", "2024-01-01 00:00:00", "ok", True), ("b", "2024-01-01 01:00:00", "error", None)], [("a", "2024-01-01 00:10:00", "ok", True), ("c", "2024-01-03 00:00:00", "ok", False)]):
        spark.createDataFrame(rows, "key string, ts string, status string, correct boolean").selectExpr("key", "cast(ts as timestamp) ts", "status", "correct").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once = ledger.once(ledger.read(spark, str(tmp_path / "in"), schema), "key", "ts", "1 day")
    q = ledger.start(once, str(tmp_path / "out"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    static = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.n, r.errors, r.accuracy) for r in ledger.running_summary(static, "ts").collect()} == {(2, 1, 1.0), (1, 0, 0.0)}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = sorted((repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()))
    assert rows
    if name not in oracle.ORACLE:
        return
    cur = duck.execute(oracle.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())


def test_entry_and_import_without_the_optional_parts(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    code = "import sys; sys.modules['tessel.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), check=True).stdout.split()
    assert int(out[0]) == len(queries.QUERIES) and out[1] == "False"


def run_cli(spark, capsys, *args):
    from tessel.__main__ import main

    code = main([str(a) for a in args], spark)
    return code, capsys.readouterr().out.strip()


def json_lines(folder):
    return [json.loads(x) for f in sorted(os.listdir(folder)) if f.startswith("part") for x in open(f"{folder}/{f}")]


def test_command_line_evaluates_shards_and_merges_them(spark, tmp_path, capsys):
    lines = [{"video_id": f"v{i // 2}", "question_id": f"q{i}", "question": f"what {i}", "options": [] if i == 5 else ["x", "y"], "answer": "AB"[i % 2]} for i in range(9)]
    (tmp_path / "qa.jsonl").write_text("\n".join(map(json.dumps, lines)))
    shared = ["evaluate", "--data", tmp_path / "qa.jsonl", "--method", "random-prune", "--setup", "lowres_base_64f", "--prune-kwargs", '{"keep_ratio": 0.5}', "--out", tmp_path / "runs"]
    runs = []
    for i in range(2):
        code, run = run_cli(spark, capsys, *shared, "--shard", f"{i}/2")
        assert code == 0
        runs.append(run)
    rows = [r for run in runs for r in json_lines(f"{run}/results.jsonl")]
    bad = [r for r in rows if r["status"] == "error"]
    assert len(rows) == 9 and [r["question_id"] for r in bad] == ["q5"] and "options" in bad[0]["error"] and bad[0]["correct"] is None
    assert json.loads(rows[0]["arm"])["pruner"] == "random" and rows[0]["prefill_tokens"] == 2048
    code, merged = run_cli(spark, capsys, "merge", "--out", tmp_path / "merged", *runs)
    summary = json.loads(spark.read.text(f"{merged}/summary.json").first().value)
    assert code == 0 and summary["n"] == 9 and [x["rows_kept"] for x in summary["merged_from"]] == [5, 4] and summary["merged_from"][0]["dir"] == runs[0]
    assert sorted(r["question_id"] for r in json_lines(f"{merged}/results.jsonl")) == [f"q{i}" for i in range(9)]
    assert run_cli(spark, capsys, *shared, "--only-videos", "none")[0] == 2
    with pytest.raises(SystemExit):
        run_cli(spark, capsys, *[a if a != '{"keep_ratio": 0.5}' else "[1]" for a in shared])


def test_grids_and_checks(spark):
    from tessel.functions import numeric

    df = spark.createDataFrame([(720, 1280, 28, 100), (40, 2000, 28, 3), (300, 300, 32, 10**6)], "h long, w long, factor long, most long")
    rows = df.select("*", numeric.fit_grid(F.col("h"), F.col("w"), F.col("factor"), F.col("most")).alias("g")).select("*", "g.*").collect()
    assert all((r.fit_h // r.factor) * (r.fit_w // r.factor) <= r.most for r in rows) and (rows[2].fit_h, rows[2].fit_w) == (288, 288)
    assert [r[0] for r in df.select(numeric.is_noop(F.col("h"), F.col("w"))).collect()] == [False, False, True]
    assert df.select(numeric.checked_tokens(F.col("h"), F.col("h"))).count() == 3
    with pytest.raises(Exception, match="tokens made"):
        df.select(numeric.checked_tokens(F.col("h"), F.col("w"))).collect()


def test_subtitles_match_whatever_the_scheme(spark, tmp_path):
    (tmp_path / "a.srt").write_text("hello")
    df = spark.createDataFrame([("a.srt",), (None,), (str(tmp_path / "a.srt"),), (f"file://{tmp_path}/a.srt",)], "subtitle_path string")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        assert sorted(r.subtitles or "" for r in qa.with_subtitles(spark, df, root).collect()) == ["", "hello", "hello", "hello"]
    assert spark.createDataFrame([("hdfs://nn:8020/x//y.srt",), ("s3a://b/x/y.srt",)], "p string").select(qa.bare(F.col("p")).alias("p")).distinct().collect()[0].p == "/x/y.srt"


def test_arm_record(spark):
    df = spark.createDataFrame([(64, 16, True), (64, 16, False)], "n long, hi long, two boolean").coalesce(1)
    given = {"model_id": F.lit("m"), "visual_tokens": F.col("n"), "hi_visual_tokens": F.col("hi"), "grid_thw": F.array(F.lit(1), F.lit(2), F.lit(3))}
    both, one = (json.loads(r.arm) for r in df.select(results.arm_record(given, F.col("two")).alias("arm")).collect())
    assert list(both) == results.ARM + results.ARM_TWO_STREAMS and both["greedy"] is True and both["prune"] is None and both["grid_thw"] == [1, 2, 3]
    assert (both["hi_visual_tokens"], one["hi_visual_tokens"], one["visual_tokens"]) == (16, None, 64)
    with pytest.raises(ValueError, match="colour"):
        results.arm_record({"colour": F.lit(1)}, F.lit(True))


def test_grids_against_plain_code_in_batches(spark):
    import math

    from tessel.functions import numeric

    def plain_grid(h, w, f, most):
        th, tw = (max(f, round(x / f) * f) // f for x in (h, w))
        if th * tw <= most:
            return th * f, tw * f
        k = math.sqrt(most / (th * tw))
        around = lambda t: range(max(1, math.floor(t * k) - 2), max(1, min(t, math.floor(t * k) + 3)) + 1)
        rated = []
        for gh in around(th):
            for gw in around(tw):
                if gh * gw <= most:
                    err = abs(math.log((gw / gh) / (w / h)))
                    rated.append((err <= 0.08, gh * gw if err <= 0.08 else -err, -err, -gh, -gw))
        return (-max(rated)[3] * f, -max(rated)[4] * f) if rated else (f, f)

    rows = [(40 + i * 37 % 1500, 60 + i * 53 % 2400, 28 + 4 * (i % 2), 1 + i * 7 % 400) for i in range(3000)]
    df = spark.createDataFrame(rows, "h long, w long, factor long, most long")
    got = df.select(numeric.fit_grid(F.col("h"), F.col("w"), F.col("factor"), F.col("most")).alias("g")).select("g.*")
    assert [tuple(r) for r in got.collect()] == [plain_grid(*r) for r in rows]
    # Grids are searched in batches, not by functions that are interpreted for each of a row's 36 grids.
    assert "array_max" not in got._jdf.queryExecution().executedPlan().toString()


def test_dual_stream_searches_its_grids_in_batches(spark):
    x = queries.QUERIES["dual_stream_tokens"](spark, SF)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") and "array_max" not in plan


def test_dry_run_chooses_once_a_peak(spark):
    from tessel.operators import selection

    texts = ["", "a", "é😀x", "question 7", None]
    df = spark.createDataFrame([(i, q, "A") for i, q in enumerate(texts)], "sample long, query string, gold string")
    budget = catalog.Budget(frame_count=5)
    scored = pipeline.fake_scores(df, 9).orderBy("sample", "idx").collect()
    peak = [None if q is None else sum(map(ord, q)) % 9 for q in texts]
    assert [r.score for r in scored] == [None if peak[r.sample] is None else 1.0 - abs(r.idx - peak[r.sample]) / 9 for r in scored] and len(scored) == 45
    want = {}
    for r in selection.top_k(pipeline.fake_scores(df, 9), 5).collect():
        want.setdefault(r["sample"], []).append(r["idx"])
    out = pipeline.select_topk(df, budget, 9)
    assert {r["sample"]: r["indices"] for r in out.collect()} == {k: sorted(v) for k, v in want.items()}
    # Samples aren't multiplied by their frames: scores are made for peaks alone.
    assert "Range (-1, 9" in out._jdf.queryExecution().optimizedPlan().toString()
