import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import payload, text
from spanforge.functions import schema as shapes

SEGMENTS = [("v", f"s{i:03d}", i, 5.0 * (i - 1), 5.0 * i, f"c/{i}.mp4") for i in range(1, 6)] + [("w", "s001", 1, 0.0, 4.996, None)]
SEGMENT = "video_id string, segment_id string, index int, start_time double, end_time double, clip_path string"


def dumped(x):
    return json.dumps(x, indent=2, ensure_ascii=False)


TEXTS = ["plain", "", "é ü 😀", 'a "b" \\ c', "tab\t new\n line\r", "\x00 \x0b \x1f \x7f", "\\u000B", "\\\\u001F\x1f", "</b> /"]


def test_pretty_json_is_that_of_a_printer(spark):
    rows = [(t, [i * 1.0, i / 3], i, i % 2 == 0, [t, None], [{"n": t, "m": []}], None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "a string, b array<double>, c bigint, d boolean, e array<string>, f array<struct<n:string,m:array<int>>>, g string")
    got = df.select(F.col("c"), payload.pretty(F.struct("*"), df.schema).alias("j")).collect()
    names = df.columns
    assert {r.c: r.j for r in got} == {r[2]: dumped(dict(zip(names, r, strict=True))) for r in rows}


NUMBERS = [0.0, -0.0, 5.0, 0.25, 1e-3, 0.00123, 1e-4, 0.00012345, 1e-5, 1.5e-7, 123456.789, 9999999.0, 1e7, 12345678.5, 123456789012.0, 1e15, 1e16, 1.25e20, -3e-9, -2e8, 0.1 + 0.2]


def test_numbers(spark):
    got = spark.createDataFrame([(x,) for x in NUMBERS], "x double").select("x", payload.number(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == {x: json.dumps(x) for x in NUMBERS}


def test_plain_lists(spark):
    rows = [([0.0, 5.25], ["a", "it's", 'say "x"', "both ' \"", "back\\slash\n"]), ([], None), (None, ["é", None])]
    df = spark.createDataFrame(rows, "r array<double>, e array<string>")
    got = df.select(payload.judge_prompts(df, "{r}|{e}", "r", "e").alias("p")).collect()
    assert [x.p for x in got] == [f"{r}|{e}" for r, e in rows]


def entry(r, caption, c="low", e="weak"):
    return {"time_range": r, "caption": caption, "confidence": c, "evidence_strength": e}


def test_prompts_of_both_kinds_of_captions(spark):
    segments = spark.createDataFrame(SEGMENTS, SEGMENT)
    own = [("v", "s002", [5.004, 9.0], "sees", "hears"), ("v", "s001", None, " ", "hears"), ("v", "s009", None, "lost", ""), ("w", "s001", [1.0], "x", None)]
    captions = spark.createDataFrame([(*r, "low", "weak") for r in own], "video_id string, segment_id string, time_range array<double>, visual_description string, audio_description string, confidence string, evidence_strength string")
    got = {r.video_id: r.prompt for r in payload.event_prompts(captions, segments, "{video_id}:{captions_json}").collect()}
    assert got == {"v": "v:" + dumped([entry([0.0, 5.0], "Audio: hears"), entry([5.0, 9.0], "Visual: sees\nAudio: hears")]), "w": "w:" + dumped([entry([0.0, 5.0], "Visual: x")])}
    flat = spark.createDataFrame(
        [("v", "c1", 1, ["s002", "s004", "s9"], "a man", "waves", "no audible cue", ["x", "y"], "low", "weak"), ("v", "c2", 2, ["s9"], "a", "b", "c", [], "low", "weak"), ("v", "c3", 3, ["s001"], "", "", "", [], "low", "weak")],
        "video_id string, caption_id string, pos int, segment_ids array<string>, person string, action string, sound string, observable_evidence array<string>, confidence string, evidence_strength string",
    )
    assert payload.captions_json(flat, segments).first().json == dumped([entry([5.0, 20.0], "Visual: a man waves x, y\nAudio: no audible cue"), entry([0.0, 5.0], "")])
    events = spark.createDataFrame([("v", "e1", "sad", "d", None, "t", ["x"], [], "low", "weak"), ("u", "e1", "sad", "d", [0.0, 1.5], "t", [], [], "low", "weak")], "video_id string, event_id string, emotion_label string, event_description string, time_range array<double>, target_person_or_group string, visual_evidence array<string>, audio_evidence array<string>, confidence string, evidence_strength string")
    made = payload.generation_prompts(captions, events, segments, "{events_json}").collect()
    assert [(r.video_id, r.prompt) for r in made] == [("v", dumped([{"event_id": "e1", "emotion_label": "sad", "event_description": "d", "time_range": None, "target_person_or_group": "t", "visual_evidence": ["x"], "audio_evidence": [], "confidence": "low", "evidence_strength": "weak"}]))]


def test_prompts_of_clips_queries_and_verdicts(spark):
    segments = spark.createDataFrame(SEGMENTS, SEGMENT)
    got = {(r.video_id, r.batch_index): (r.segment_ids, r.media, r.prompt) for r in payload.caption_prompts(segments, "{video_id} {batch_index}\n{segment_list}", 2).collect()}
    assert got["v", 0] == (["s001", "s002"], ["c/1.mp4", "c/2.mp4"], "v 0\nClip 1 -> s001 (0.00-5.00s)\nClip 2 -> s002 (5.00-10.00s)")
    assert got["w", 0] == (["s001"], [""], "w 0\nClip 1 -> s001 (0.00-5.00s)") and len(got) == 4
    queries = spark.createDataFrame([("v", "q2", "b"), ("v", "q1", "a «»")], "video_id string, query_id string, query_text string")
    one = payload.verification_prompts(queries, "{video_id}/{round_index}/{queries_json}", 2).first().prompt
    assert one == "v/2/" + dumped([{"query_id": "q1", "query_text": "a «»"}, {"query_id": "q2", "query_text": "b"}])
    captions = spark.createDataFrame([("v", "s002", "sees"), ("v", "s003", "more")], "video_id string, segment_id string, visual_description string").selectExpr("*", "cast(null as array<double>) time_range", "'' audio_description", "'low' confidence", "'weak' evidence_strength")
    candidates = spark.createDataFrame([("v", "q1", ["s001", "s002", "s003"]), ("v", "q2", ["s001"])], "video_id string, query_id string, candidates array<string>")
    found = payload.regrounding_prompts(queries, captions, segments, candidates, "{queries_json}").first().prompt
    shown = [{"segment_id": "s002", "time_range": [5.0, 10.0], "caption": "Visual: sees"}, {"segment_id": "s003", "time_range": [10.0, 15.0], "caption": "Visual: more"}]
    assert found == dumped([{"query_id": "q1", "query_text": "a «»", "candidate_segments": shown}, {"query_id": "q2", "query_text": "b", "candidate_segments": []}])
    failing = queries.where("query_id = 'q1'").selectExpr("*", "'t' query_type", "'g' grounding_event_description", "cast(null as string) approximate_grounding_time", "'p' target_person_or_group", "'revise' decision", "'r' failure_reason", "'s' suggested_revision")
    want = dict(zip(payload.REWRITE_FIELDS, ["q1", "t", "a «»", "g", None, "p", "revise", "r", "s"], strict=True))
    assert payload.rewrite_prompts(failing, "{queries_with_feedback_json}", 1).first().prompt == dumped([want])


GOOD = {"segment_id": "s", "time_range": [0, 5], "visual_description": "", "audio_description": "a", "confidence": "low", "evidence_strength": "weak"}
BAD = [
    (None, "not_found", None),
    ("x", "json_parse_error", None),
    ("[1]", "json_parse_error", None),
    ({}, None, None),
    ({"time_range": [1]}, "missing_required_fields", "time_range: missing"),
    ({"time_range": "ab"}, "missing_required_fields", "time_range: missing"),
    ({"confidence": None}, "missing_required_fields", "confidence: missing"),
    ({"time_range": ["1", 2.5]}, None, None),
    ({"time_range": ["x", 1]}, "schema_validation_error", "time_range[]: not a number"),
    ({"confidence": "none"}, "schema_validation_error", "confidence: not one of low, medium, high"),
    ({"visual_description": 3}, "schema_validation_error", "visual_description: not a string"),
    ({"visual_objective": {"people": [{}, {"person": 4}]}}, "schema_validation_error", "visual_objective.people[].person: not a string"),
    ({"visual_objective": None}, "schema_validation_error", "visual_objective: null"),
    ({"visual_expression": [{"gaze": "x", "facial_cues": [1, None]}]}, None, None),
    ({"visual_expression": [None]}, "schema_validation_error", "visual_expression[]: null"),
]


def test_documents_are_checked_with_a_reason(spark):
    raw = [json.dumps(GOOD | x) if isinstance(x, dict) else x for x, _, _ in BAD]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", shapes.checked(F.col("raw"), shapes.CAPTION).alias("c")).collect()
    assert [(r.c.reason, r.c.rule) for r in sorted(got, key=lambda r: r.i)] == [(reason, rule) for _, reason, rule in BAD]


NUMERIC = {
    "n": shapes.Is("whole", required=True, low=1, high=5),
    "b": shapes.Is("boolean"),
    "t": shapes.Is("string", nullable=True, size=(2, 3)),
    "a": shapes.Is("array", size=(0, 2)),
}


@pytest.mark.parametrize(
    "value,rule",
    [
        ({"n": 3}, None), ({"n": "4"}, None), ({"n": 2.0}, None), ({"n": 2.5}, "n: not a whole"), ({"n": 0}, "n: below 1"), ({"n": 9}, "n: above 5"), ({"n": True}, None), ({}, "n: missing"),
        ({"n": 1, "b": "yes"}, None), ({"n": 1, "b": 2}, "b: not a boolean"), ({"n": 1, "t": "x"}, "t: not of size 2 to 3"), ({"n": 1, "t": None}, None), ({"n": 1, "a": [1, 2, 3]}, "a: not of size 0 to 2"), ({"n": 1, "a": {}}, "a: not an array"),
    ],
)
def test_bounds_and_sizes(spark, value, rule):
    row = spark.createDataFrame([(json.dumps(value),)], "raw string").select(shapes.checked(F.col("raw"), NUMERIC).alias("c")).first().c
    assert row.rule == rule


def test_strict_captions_and_events(spark):
    replies = ["x</think>```json\n" + json.dumps(GOOD | {"segment_id": "zz", "visual": "V"}) + "\n``` that is all", json.dumps(GOOD | {"visual_description": "own", "visual": "V"}) + " {", "no", json.dumps(GOOD | {"confidence": 1}), None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, raw string").select("i", shapes.strict_caption(F.col("raw"), F.lit("v"), F.lit("s001"), F.lit(0.0), F.lit(5.004)).alias("c")).orderBy("i").collect()
    assert [r.c.caption and (r.c.caption.segment_id, r.c.caption.time_range, r.c.caption.visual_description) for r in got] == [("s001", [0.0, 5.0], "V"), ("s001", [0.0, 5.0], "own"), None, None, None]
    assert [r.c.reason for r in got] == [None, None, "json_parse_error", "schema_validation_error", "json_parse_error"]
    events = {"events": [{"emotion_label": "sad", "event_description": "d"}, {"emotion_label": "joy", "event_description": "d"}, 5, {"event_description": "d"}]}
    found = spark.createDataFrame([(json.dumps(events),), ("none",)], "raw string").select(shapes.good_events(F.col("raw")).alias("e")).collect()
    assert [(e.pos, e.rule is None) for e in found[0].e] == [(1, True), (2, False), (4, False)] and found[1].e == []


def test_once_is_used(spark):
    assert text.once(F.lit(1), lambda x: x) is not None
