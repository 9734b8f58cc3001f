import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge.operators import evals, judging, quality, similarity, stages, stats
from spanforge.sources import catalog, records
from spanforge.sources.model import FakeClient

SMALL = "/root/testdata/sf0.001"
NAMES = ["run_round_trip", "runs_merged", "review_rows", "judge_captions_fake", "judge_summary_fake", "verify_batched_fake", "grounding_score", "too_narrow_proposals", "topk_cosine", "recall_at_n", "violations_by_kind", "stats_row", "source_captions", "first_extension", "videos_replaced", "stage_outputs", "scored_rows", "verification_metrics", "answers_appended", "stream_islands", "checked_documents", "event_rules", "stage_counters", "resample_sizes", "batched_answers_fake", "generation_prompts", "judge_prompt_texts", "clip_prompts", "verified_by_dimension_fake", "reground_table", "extracted_clips", "empty_stages", "similar_spans", "word_overlap_pairs", "cue_inputs", "predictions_read"]


def shown(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "labels", "documents", "embeddings", "orders", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    answer = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    want = sorted(tuple(map(shown, r)) for r in answer.fetchall())
    got = entry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(shown, r)) for r in got.select(*names).collect()) == want


def test_documents_are_written_whole_and_results_appended_once(spark, tmp_path):
    for k in (1, 2):
        catalog.write_document(spark, str(tmp_path / "stats.json"), {"n": k, "é": "ü"})
    assert catalog.read_document(spark, str(tmp_path / "stats.json")) == {"n": 2, "é": "ü"}
    assert not list(tmp_path.glob("*.tmp"))
    for n in (3, 5):
        catalog.append_results(spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("v")), str(tmp_path / "rows"), ["k"])
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "rows")).collect()) == [0, 1, 2, 3, 4]


def test_run_reload_models_and_missing_tables(spark, tmp_path):
    segments = spark.createDataFrame([("v", "s001", 1, 0.0, 5.0, "clips/v/s001.mp4")], records.SEGMENT)
    catalog.write_run({"segments": segments}, str(tmp_path / "a"))
    back = catalog.read_run(spark, str(tmp_path / "a"))
    assert back["segments"].collect() == segments.collect() and back["captions"].count() == 0
    both = catalog.scan_models(spark, {"m1": str(tmp_path / "a"), "m2": str(tmp_path / "a")}, "segments")
    assert sorted(r.model for r in both.collect()) == ["m1", "m2"]
    with pytest.raises(TypeError, match="lacks end"):
        catalog.check_columns({"segments": segments}, {"segments": ["segment_id", "end"]})
    with pytest.raises(TypeError, match="no table"):
        catalog.check_columns({}, {"segments": []})
    row = segments.select(catalog.cache_path("c", F.lit("m"), F.col("video_id"), F.col("segment_id")).alias("p")).first()
    assert row.p == "c/m/v/s001.json"


def test_clips_of_events(spark):
    rows = spark.createDataFrame([("v", "s1", "old", 1), ("v", "s1", "new", 2), ("v", "s2", None, 1)], "video_id string, segment_id string, clip_path string, pos int")
    clips = catalog.clip_map(rows, "pos")
    assert [tuple(r) for r in clips.collect()] == [("v", "s1", "new")]
    events = spark.createDataFrame([("v", "e1", ["s2", "s1"]), ("v", "e2", [])], "video_id string, event_id string, segment_ids array<string>")
    assert {r.event_id: r.clip_paths for r in catalog.event_clips(events, clips).collect()} == {"e1": ["new"], "e2": []}
    kept, lost = judging.with_clip(rows.select("video_id", "segment_id").distinct(), clips, ["video_id", "segment_id"])
    assert (kept.count(), lost.count()) == (1, 1)


def test_judging_never_raises(spark):
    def answer(prompt):
        raise RuntimeError("down")

    events = spark.createDataFrame([("v", "e1", [0.0, 5.0], "sad", "d", ["x"], None), ("v", "e2", None, "sad", "d", None, None)], "video_id string, event_id string, time_range array<double>, emotion_label string, event_description string, visual_evidence array<string>, audio_evidence array<string>")
    clips = spark.createDataFrame([("v", "e1", ["c"])], "video_id string, event_id string, clip_paths array<string>")
    from spanforge.sources import model

    keep, model.retry_delay.__defaults__ = model.retry_delay.__defaults__, (0,)
    try:
        got = {r.event_id: r.parse_error for r in judging.judge_events(events, clips, lambda: FakeClient(answer)).collect()}
    finally:
        model.retry_delay.__defaults__ = keep
    assert got["e2"] == "no clip(s) found for event e2" and "judge call failed" in got["e1"]


def test_rewrites_keep_to_what_was_asked(spark):
    rejected = spark.createDataFrame([("v", "q1", "a", "weak")], "video_id string, query_id string, text string, failure_reason string")
    reply = '{"rewrites": [{"query_id": "q1", "rewritten_query_text": "b"}, {"query_id": "q9", "rewritten_query_text": "c"}]}'
    got = judging.rewrite_stage(rejected, lambda: FakeClient(lambda p: reply), 2).collect()
    assert [(r.query_id, r.rewritten_query_text, r.round_index) for r in got] == [("q1", "b", 2)]
    assert judging.readable("x {\"a\": 1} y") and judging.readable("[1]") and not judging.readable("none") and not judging.readable("{")


def test_similar_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k % 3), i, " ".join(rng.choice(list("abcdefgh"), size=rng.integers(0, 7)))) for i, k in enumerate(rng.integers(0, 9, 90))]
    classes = {}
    for k, i, x in rows:
        if x:
            classes.setdefault((k, frozenset(x.split())), []).append(i)
    want = {(k, min(m), min(m), len(m) * (len(m) - 1) // 2) for (k, _), m in classes.items() if len(m) > 1}
    for (k, a), m in classes.items():
        for (j, b), n in classes.items():
            if k == j and min(m) < min(n) and len(a & b) / max(len(a), len(b)) >= 0.7:
                want.add((k, min(m), min(n), len(m) * len(n)))
    got = quality.similar_pairs(spark.createDataFrame(rows, "k long, i long, x string"), "k", "i", "x")
    assert {(r.k, r.a, r.b, r.pairs) for r in got.collect()} == want and got.count() == len(want)


def test_equal_texts_are_one_class(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit("five words of one text").alias("x"))
    assert [tuple(r) for r in quality.similar_pairs(rows, "k", "i", "x").collect()] == [(1, 0, 0, 5000 * 4999 // 2, 1.0)]


def test_nearest_vectors_of_any_shape(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [3.0]), (2, [1e200, 1e200]), (3, [1e-200, 0.0, 0.0, 0.0, 0.0]), (4, None), (5, [0.0]), (6, [1.0, None]), (7, [float("nan")]), (8, []), (None, [1.0]), (9, [0.0, 0.0, 0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = similarity.nearest(df.where("id = 0"), df, 10).orderBy("rk").collect()
    assert [(r.id, round(r.s, 6)) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.707107), (9, 0.0)]
    assert similarity.nearest(df.where("id = 4"), df, 3).count() == 0


def test_nearest_in_any_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 5))
    v[7] = v[8]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(120, None), (121, [0.0] * 5), (122, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(u @ u.T, 9)
    want = {(q, c, k + 1) for q in range(0, 120, 10) for k, c in enumerate(sorted((c for c in range(120) if c != q), key=lambda c: (-near[q, c], c))[:4])}
    for block, part in ((1024, 16_384), (3, 17)):
        got = similarity.nearest(df.where("id % 10 = 0"), df, 4, block, part)
        assert {(r["query"], r.id, r.rk) for r in got.collect()} == want


def test_bootstrap_interval_of_a_known_mean(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2).cast("double").alias("x"))
    lo, hi = evals.bootstrap(rows, "x", "id").first()
    sd = 0.5 / 4000**0.5
    assert abs(lo - (0.5 - 1.96 * sd)) < sd and abs(hi - (0.5 + 1.96 * sd)) < sd
    assert evals.bootstrap(rows, "x", "id").first() == (lo, hi)
    assert tuple(evals.bootstrap(rows.limit(0), "x", "id").first()) == (None, None)


def test_event_draws_stop_at_the_first_that_fits(spark):
    asked = []

    class Counting:
        def ask(self, prompt, media):
            return "[]"

    captions = spark.createDataFrame([("v", "s001", [0.0, 5.0], "a", "b")], "video_id string, segment_id string, time_range array<double>, visual_description string, audio_description string")
    segments = spark.createDataFrame([("v", "s001", 1, 0.0, 5.0)], "video_id string, segment_id string, index int, start_time double, end_time double")
    real = stages.model_stage
    stages.model_stage = lambda work, client, *a, **k: (asked.append(work.count()), real(work, client, *a, **k))[1]
    try:
        assert stages.event_stage(captions, segments, Counting, 2.5).count() == 0
    finally:
        stages.model_stage = real
    assert asked == [1]


def test_similar_spans_stage_times_and_warnings(spark):
    pairs = spark.createDataFrame([(1, 0.0, 5.0, 0.9), (1, 5.0, 10.0, 0.8), (1, 30.0, 35.0, 0.95), (1, 50.0, 55.0, 0.1)], "k long, start double, end double, s double")
    assert [tuple(r) for r in evals.similar_span(pairs, "k", 0.5).collect()] == [(1, 0.0, 10.0)]
    ticks = iter([0.0, 2.0, 2.0, 5.0])
    times = catalog.StageTimes(lambda: next(ticks))
    for video in ("a", "b"):
        with times.stage(video, "captions"):
            pass
    total = stats.usage(times.table(spark), "stage", ["seconds"]).where("stage is null").first()
    assert (total.calls, total.seconds) == (2, 5.0)
    row = spark.range(1).select(stats.warnings(F.array(F.lit("WARNING: x"), F.lit("fine"))).alias("w")).first()
    assert row.w == ["WARNING: x"]


def test_queries_of_events_are_numbered_by_video(spark):
    events = spark.createDataFrame([("v", "e1", [0.0, 5.0], ["s1"], "d", "A"), ("v", "e2", [5.0, 9.0], ["s2"], "f", "B")], "video_id string, event_id string, time_range array<double>, segment_ids array<string>, event_description string, target_person_or_group string")
    asked = spark.createDataFrame([("v", "e2", 0, "t", "x"), ("v", "e1", 0, "t", "y"), ("v", "e1", 1, "t", "z")], "video_id string, event_id string, pos int, query_type string, query_text string")
    got = {r.query_id: (r.query_text, r.segment_ids) for r in judging.placed_queries(events, asked).collect()}
    assert got == {"v_mm001": ("y", ["s1"]), "v_mm002": ("z", ["s1"]), "v_mm003": ("x", ["s2"])}
