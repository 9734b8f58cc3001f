import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanforge.operators import batches
from spanforge.sources.model import FakeClient
from spanforge.streaming import append, islands

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
SEGMENT = "video_id string, segment_id string, index int, start_time double, end_time double, clip_path string"
SEGMENTS = [("v", f"s{i:03d}", i, 5.0 * (i - 1), 5.0 * i, f"c{i}") for i in range(1, 8)]


def item(i, **more):
    return {"segment_id": f"s{i:03d}", "time_range": [0, 1], "visual_description": f"sees {i}", "audio_description": "", "confidence": "high", "evidence_strength": "clear"} | more


REPLIES = {
    "s001": [item(2), item(1), item(3)],  # out of order, by id
    "s004": [item(4), {"visual": "no id"} | {k: v for k, v in item(5).items() if k not in ("segment_id", "visual_description")}, item(6, confidence="sure")],
    "s007": None,
}


class Captions:
    def ask_many(self, items):
        out = []
        for prompt, media in items:
            first = prompt.split("Clip 1 -> ")[1][:4]
            if REPLIES[first] is None:
                raise RuntimeError("no memory")
            assert len(media) == prompt.count("Clip ")
            out.append("Sure:\n```json\n" + json.dumps(REPLIES[first]) + "\n```")
        return out


def test_captions_of_several_clips(spark):
    segments = spark.createDataFrame(SEGMENTS, SEGMENT)
    got = {r.segment_id: r for r in batches.caption_batches(segments, None, Captions, "{segment_list}", 3, 3).collect()}
    assert {k: r.status for k, r in got.items()} == {"s001": "valid", "s002": "valid", "s003": "valid", "s004": "valid", "s005": "salvaged", "s006": "salvaged", "s007": "failed"}
    assert all(got[f"s{i:03d}"].visual_description == f"sees {i}" for i in (1, 2, 3, 4, 6))
    assert got["s005"].visual_description == "no id" and got["s005"].reason == "missing_required_fields" and got["s005"].confidence == "low"
    assert got["s006"].reason == "schema_validation_error" and got["s006"].evidence_strength == "weak"
    assert got["s007"].visual_description is None and got["s007"].reason == "RuntimeError: no memory"
    assert got["s004"].time_range == [15.0, 20.0] and got["s004"].confidence == "high"
    done = spark.createDataFrame([("v", f"s{i:03d}") for i in (1, 2, 3, 7)], "video_id string, segment_id string")
    assert {r.segment_id for r in batches.caption_batches(segments, done, Captions, "{segment_list}", 3).collect()} == {"s004", "s005", "s006"}


class Dimensions:
    def ask_many(self, items):
        if any("q4" in p and "answer" in p for p, _ in items):
            raise RuntimeError("out of memory")
        assert all(len(m) == ("answer" in p) for p, m in items)  # a call is all text or all clips
        out = []
        for p, _ in items:
            dim = p.split(":")[0]
            out.append("no idea" if "q2" in p and dim == "query_quality_pass" else json.dumps({dim: "q3" not in p, "reason": "because"}))
        return out


def test_each_dimension_by_itself(spark):
    rows = spark.createDataFrame([("v", f"q{i}", f"text {i}", ["clip"]) for i in range(1, 6)], "video_id string, query_id string, query_text string, media array<string>")
    templates = {d: f"{d}:{{queries_json}}" for d in batches.WATCHES}
    got = {r.query_id: r for r in batches.verify_by_dimension(rows, Dimensions, templates, 2, 2).collect()}
    assert {k: (r.decision, r.failure_reason) for k, r in got.items()} == {
        "q1": ("pass", ""),
        "q2": ("revise", "query_quality: invalid format"),
        "q3": ("fail", "emotion_relevance: because; answerability: call failed; query_quality: because"),
        "q4": ("fail", "answerability: call failed"),
        "q5": ("pass", ""),
    }
    assert got["q1"].round_index == 2


def choices(prompt):
    if "broken" in prompt:
        raise RuntimeError("down")
    return 'Here {"groundings": [{"query_id": "q1", "segment_ids": ["s003", "s002"]}, {"query_id": "q2", "segment_ids": ["s001", "s003"]}, {"query_id": "q3", "segment_ids": ["s009"]}, {"query_id": "q4", "segment_ids": ["s005"]}, {"query_id": "q5", "segment_ids": ["s001", "s001"]}]}'


@pytest.mark.parametrize("window,moved", [(None, {"q1": "changed", "q4": "changed"}), (2, {"q1": "changed"})])
def test_regrounding_falls_back(spark, window, moved, monkeypatch):
    from spanforge.sources import model

    monkeypatch.setattr(model.retry_delay, "__defaults__", (0,))
    segments = spark.createDataFrame([*SEGMENTS, ("broken", "s001", 1, 0.0, 5.0, None)], SEGMENT)
    rows = [("v", f"q{i}", f"t{i}", [0.0, 5.0], ["s001"], ["old"]) for i in range(1, 7)] + [("broken", "q1", "x", None, ["s001"], ["old"])]
    queries = spark.createDataFrame(rows, "video_id string, query_id string, query_text string, time_range array<double>, segment_ids array<string>, source_caption_ids array<string>")
    captions = spark.createDataFrame([("v", "s002", "a"), ("v", "s005", "b"), ("v", "s003", "c")], "video_id string, segment_id string, visual_description string").selectExpr("*", "cast(null as array<double>) time_range", "'' audio_description", "'low' confidence", "'weak' evidence_strength")
    got = {(r.video_id, r.query_id): r for r in batches.reground_stage(queries, captions, segments, lambda: FakeClient(choices), "{video_id} {queries_json}", window).collect()}
    assert len(got) == 7
    assert {q: r.outcome for (v, q), r in got.items() if v == "v"} == {f"q{i}": moved.get(f"q{i}", "fallback") for i in range(1, 7)}
    one = got["v", "q1"]
    assert (one.segment_ids, one.time_range, one.gen_segment_ids, one.gen_time_range, one.source_caption_ids) == (["s002", "s003"], [5.0, 15.0], ["s001"], [0.0, 5.0], ["v_s002", "v_s003"])
    lost = got["broken", "q1"]
    assert (lost.outcome, lost.segment_ids, lost.time_range, lost.gen_time_range, lost.source_caption_ids) == ("fallback", ["s001"], None, [], ["old"])


def test_stream_that_stops_half_way_holds_each_key_once(spark, tmp_path):
    work = spark.range(100).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    for k in range(5):
        work.where(f"key % 5 = {k} or key = 7").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(work.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    schema = work.select("key", F.lit("").alias("answer")).schema
    seen = []

    def answer(rows):
        seen.append(rows.count())
        if len(seen) == 3:
            raise RuntimeError("stopped")
        return rows.select("key", F.col("x").cast("string").alias("answer"))

    run = lambda: append.append_as_you_go(stream, answer, schema, ["key"], str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="stopped"):
        run()
    half = append.answered(spark, str(tmp_path / "out"), schema).count()
    assert 0 < half < 100
    run()
    run()  # nothing is left
    rows = append.answered(spark, str(tmp_path / "out"), schema)
    assert sorted((r.key, r.answer) for r in rows.collect()) == [(i, str(2 * i)) for i in range(100)]
    assert rows.select("batch").distinct().count() == 5


def test_islands_of_a_stream_wait_for_late_rows(spark, tmp_path):
    hour = 3_600_000_000
    rows = [("a", 1, 0, "x"), ("a", 2, 5, "x"), ("a", 3, 3, "y"), ("b", 4, 1, "x"), ("a", 5, 4, "x"), ("a", 6, 60, "x"), (None, 7, 2, "x"), ("b", 8, 70, "x"), ("b", 9, 1, None)]
    df = spark.createDataFrame(rows, "k string, id long, h long, label string").select("k", "id", "label", ((F.col("h") + 1000) * hour).alias("start"), ((F.col("h") + 1001) * hour).alias("end"), F.timestamp_micros((F.col("h") + 1000) * hour).alias("ts"))
    for part in ("id <= 2", "id between 3 and 5", "id > 5"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    islands.flush_row(df, "ts").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = islands.islands(stream, "k", "ts", "start", "end", "id", "label", hour, "1 day")
    out = islands.drain(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()
    got = sorted((r.k, r.island, r.label, r.ids, r.n) for r in out)
    assert got == [("a", 0, "x", [1], 1), ("a", 1, "y", [3], 1), ("a", 2, "x", [5, 2], 2), ("a", 3, "x", [6], 1), ("b", 0, "x", [4], 1), ("b", 1, None, [9], 1), ("b", 2, "x", [8], 1)]
    # a row behind the watermark is gone
    late = spark.createDataFrame([("a", 10, 1, "x")], "k string, id long, h long, label string").select("k", "id", "label", ((F.col("h") + 1000) * hour).alias("start"), ((F.col("h") + 1001) * hour).alias("end"), F.timestamp_micros((F.col("h") + 1000) * hour).alias("ts"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    assert islands.drain(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).count() == len(got)


def test_warnings_and_clips(spark):
    videos = spark.createDataFrame([("a",), ("b",)], "video_id string")
    told = batches.run_warnings(videos.where("video_id = 'a'"), videos.limit(0), videos).collect()
    assert sorted((r.video_id, r.stage) for r in told) == [("a", "queries"), ("b", "events"), ("b", "queries")]
    segments = spark.createDataFrame(SEGMENTS, SEGMENT)
    clips = spark.createDataFrame([("v", 2, "new"), ("v", 2, "cut"), ("w", 1, "x")], "video_id string, index int, clip_path string")
    got = {r["index"]: r.clip_path for r in batches.with_extracted_clips(segments, clips).collect()}
    assert got == {i: "new" if i == 2 else None for i in range(1, 8)}


def test_cues_are_flagged_unless_a_clip_shows_them(spark, tmp_path):
    from spanforge.sources import inputs

    lines = [{"query_id": "q1", "label": "GOOD", "cue": ["a smile", "a wave"], "clips": ["x/1.mp4", "x/2.mp4"]}, {"query_id": "q2", "label": "HALLUC", "cue": "tears", "clips": ["x/1.mp4"]}, {"query_id": "q3", "label": "GOOD", "cue": "x", "clips": []}]
    (tmp_path / "cues.jsonl").write_text("\n".join(map(json.dumps, lines)))
    cues = inputs.read_cues(spark, str(tmp_path / "cues.jsonl"))

    class Eyes:
        def ask(self, prompt, media):
            return " Yes, clearly" if "smile; a wave" in prompt and media == ["x/2.mp4"] else "no " + "n" * 200

    got = {r.query_id: r for r in inputs.cue_stage(cues, Eyes, "Do you see {cue}?").collect()}
    assert {k: r.flagged_hallucination for k, r in got.items()} == {"q1": False, "q2": True, "q3": True}
    assert [(c.clip, c.verdict) for c in got["q1"].per_clip] == [("1.mp4", "NO"), ("2.mp4", "YES")] and len(got["q2"].per_clip[0].reply) == 120
    assert got["q3"].per_clip == []


def test_samples_and_selections_stay(spark, tmp_path):
    from spanforge.sources import inputs

    files = spark.createDataFrame([(f"p/{i}.mp4", f"v{i}") for i in range(50)], "path string, video_id string")
    one = {r.video_id for r in inputs.sampled(files, 7, 3).collect()}
    assert len(one) == 7 and one == {r.video_id for r in inputs.sampled(files.orderBy(F.rand()), 7, 3).collect()} != {r.video_id for r in inputs.sampled(files, 7, 4).collect()}
    first = inputs.selection(files, 5, str(tmp_path / "s")).collect()
    assert inputs.selection(files.limit(1), 9, str(tmp_path / "s")).collect() == first and len(first) == 5
