import json
import re

from pyspark.sql import functions as F

from spanforge.functions import json_text, text, verdicts
from spanforge.operators import annotations, citations, evals, stages
from spanforge.sources import prompts
from spanforge.sources.model import FakeClient

ANNOTATION = "video_id string, query_id string, pos int, query_type string, final_query_text string, initial_query_text string, segment_ids array<string>, approximate_time string, human_emotion_relevant string, human_answerability string, human_query_quality string"


def annotated(spark):
    rows = [
        ("v", "q1", 0, None, "", "first", ["s011"], "s011 (50-54.4s)", "pass", "pass", "pass"),
        ("v", "q2", 1, "evidence_cue", "final", "first", ["s011", "s002"], "", "pass", "fail", "pass"),
        ("v", "q3", 2, "", None, None, [], None, "pass", "pass", None),
        ("v", "q4", 3, "x", "t", None, ["s002"], "(5 - 9 s)", "pass", "pass", "fail"),
        ("v", "q5", 4, "x", "t", None, ["s002"], "(6-8s)", "skip", "pass", "fail"),
        ("w", "q6", 5, "x", "t", None, ["last"], None, "pass", "pass", "fail"),
        ("w", "q7", 6, "x", "t", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, ANNOTATION)


def test_annotations(spark, tmp_path):
    a = annotated(spark)
    gold = {r.query_id: (r.query_text, r.gold_answerability, r.gold_decision) for r in annotations.gold(a).collect()}
    assert gold["q1"] == ("first", True, "pass") and gold["q2"] == ("final", False, "fail")
    assert gold["q4"][2] == "revise" and gold["q3"] == ("", None, None) and gold["q5"][1:] == gold["q7"][1:] == (None, None)
    q = {r.query_id: (r.query_type, r.time_range) for r in annotations.annotated_queries(a).collect()}
    assert q["q1"] == ("emotion_state", [50, 54.4]) and q["q2"] == ("evidence_cue", [5, 55]) and q["q3"] == ("emotion_state", None) and q["q7"][1] is None
    s = {(r.video_id, r.segment_id): (r["index"], r.start_time, r.end_time) for r in annotations.annotated_segments(a).collect()}
    assert s == {("v", "s011"): (11, 50, 54.4), ("v", "s002"): (2, 6, 8), ("w", "last"): (1, 0, 5)}
    annotations.write_eval_inputs(a, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/gold")).count() == 7
    nested = {r.video_id: len(r.queries) for r in spark.read.json(str(tmp_path / "out/initial_queries")).collect()}
    assert nested == {"v": 5, "w": 2}


def test_set_on_citations(spark):
    segments = spark.createDataFrame([("v", f"s{i:03d}", 5.0 * (i - 1), 5.0 * i) for i in (1, 2, 4, 5, 6)], "video_id string, segment_id string, start_time double, end_time double")
    e = [
        ("v", 0, "a", [0.0, 1.0], ["[s002] x", "[s099] y"], ["  [s005] z"], "high", "clear", "A", None),
        ("v", 1, "", [7.0, 16.0], ["no place"], None, None, None, "", "group"),
        ("v", 2, "c", [0.0, 5.0], ["[s001]"], [], "LOW", "clear", None, None),
        ("v", 3, "d", [0.0, 5.0], ["[s001]"], [], "high", "Weak", None, None),
        ("v", 4, "e", [11.0, 14.0], [], [], "high", "clear", None, None),
        ("v", 5, "f", [11.0], [], [], "high", "clear", None, None),
        ("v", 6, None, [0.0, 5.0], ["[s001] w"], None, "high", "clear", None, None),
        ("u", 7, "g", [0.0, 5.0], ["[s001] w"], None, "high", "clear", None, None),
    ]
    events = spark.createDataFrame(e, "video_id string, pos int, event_id string, time_range array<double>, visual_evidence array<string>, audio_evidence array<string>, confidence string, evidence_strength string, target_person string, target_person_or_group string")
    kept = citations.set_on_citations(events, segments)
    got = {r.pos: r for r in kept.collect()}
    assert set(got) == {0, 1, 6}
    assert got[0].segment_ids == ["s002", "s004", "s005"] and got[0].time_range == [5, 25] and got[0].range_fixed
    assert got[0].target_person_or_group == "A" and got[1].target_person_or_group == "group" and got[1].event_id == "e1"
    assert got[1].segment_ids == ["s002", "s004"] and got[1].time_range == [5, 20] and not got[1].range_fixed
    assert got[6].event_id == "e6" and not got[6].range_fixed
    assert citations.citation_counts(events, kept).first().asDict() == {"in": 8, "dropped_lowconf": 2, "range_fixed": 1, "kept": 3}


def judged(spark, expr, rows):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)], "i int, raw string")
    return [r[0] for r in df.select("i", expr(F.col("raw")).alias("v")).orderBy("i").select("v").collect()]


def test_judge_verdicts(spark):
    whole = {d: {"score": 3, "reason": "r"} for d in verdicts.CAPTION_DIMENSIONS} | {"emotion_leakage_ok": {"score": 0, "reason": None}}
    rows = judged(spark, verdicts.caption_verdict, [whole, whole | {"coverage": {"score": "4.5"}, "fluency": 3}, "none", None, whole | {"faithfulness": {"score": " 5 ", "reason": 7}}, "{broken", whole | {"hallucination": {"score": 4.9}}])
    assert rows[0].parse_error is None and rows[0].fluency == (3, "r") and rows[0].emotion_leakage_ok.score == 0
    assert rows[1].parse_error == "missing/invalid dimension: coverage" and rows[1].fluency == (None, "")
    assert rows[2].parse_error == rows[3].parse_error == "response is not a JSON object" and rows[2].coverage.score is None
    assert rows[4].faithfulness == (5, "7") and rows[6].hallucination.score == 4 and rows[5].parse_error is not None
    e = {"cue_sufficiency": {"score": 1}, "cue_grounded": {"score": 5}, "label_agreement": {"agree": True, "predicted_label": " Sad ", "reason": "x"}}
    rows = judged(spark, lambda c: verdicts.event_verdict(c, F.lit("sad ")), [e, e | {"label_agreement": {"predicted_label": "happy"}}, e | {"label_agreement": {"predicted_label": " "}}, e | {"label_agreement": 1}])
    assert rows[0].label_agreement == (1, "x", "Sad") and rows[0].parse_error is None and rows[1].label_agreement.score == 0
    assert [r.parse_error for r in rows[2:]] == ["missing/invalid dimension: label_agreement"] * 2


def test_verifier_lists(spark):
    p = {"emotion_relevance_pass": True, "answerability_pass": True, "query_quality_pass": True, "query_id": "q", "decision": "fail"}
    raw = {"results": [p, p | {"query_quality_pass": "true", "video_id": "own"}, p | {"answerability_pass": 1}, {"query_id": "z"}]}
    (got, none) = judged(spark, lambda c: verdicts.verification_results(c, F.lit("v"), F.lit(2)), [raw, "no"])
    assert [r.decision for r in got] == ["pass", "revise", "fail", "fail"] and [r.video_id for r in got] == ["v", "own", "v", "v"]
    assert got[3].failure_reason == "" and got[0].round_index == 2 and none is None
    (got,) = judged(spark, lambda c: verdicts.rewrites(c, F.lit("v"), F.lit(1)), [{"rewrites": [{"query_id": "a", "round_index": 3}, {"query_id": "b"}]}])
    assert [(r.query_id, r.round_index, r.video_id) for r in got] == [("a", 3, "v"), ("b", 1, "v")]


def test_cue_check(spark):
    rows = [(1, "HALLUC", "No"), (1, "HALLUC", None), (2, "HALLUC", " yes"), (2, "HALLUC", "no"), (3, "GOOD", "not yes"), (4, "GOOD", "Yes!")]
    checked = evals.cue_check(spark.createDataFrame(rows, "k int, label string, reply string"), "k", "label")
    assert tuple(evals.cue_confusion(checked, "label").first()) == (1, 1, 1, 1)


def test_prompt_lines(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.grid_lines(F.lit(12.5))) == "s000: 0-5s\ns001: 5-10s\ns002: 10-12s" and value(text.grid_lines(F.lit(0.0))) == ""
    s = F.array(F.struct(F.lit("s001").alias("segment_id"), F.lit(0.0).alias("start_time"), F.lit(5.0).alias("end_time")))
    assert value(text.clip_lines(s)) == "Clip 1 -> s001 (0.00-5.00s)"
    assert value(text.caption_span(F.array(F.lit(1.239)), F.lit(0.0), F.lit(2.468))) == [0, 2.47]
    assert value(text.caption_span(F.array(F.lit(1.239), F.lit(2.0)), F.lit(None), F.lit(None))) == [1.24, 2]
    row = '{"people":[{"person":"a man","action":"runs"},{"person":"","action":null}],"scene":{"location":"park","setting":""},"ex":[{"person":"a man","facial_cues":["smile",""],"body_cues":null},{"person":"b","facial_cues":[],"body_cues":[]}]}'
    p = F.from_json(F.lit(row), "people array<struct<person:string,action:string>>, scene struct<location:string,setting:string>, ex array<struct<person:string,facial_cues:array<string>,body_cues:array<string>>>")
    assert value(text.visual_prose(p["people"], p["scene"], p["ex"], F.lit(" then leaves "))) == "a man runs Scene: park a man: smile then leaves"


def test_captions_by_model(spark):
    rows = [("audio_video", None, "A sad, low voice", "a man walks", "af3_vl"), ("audio_video", None, " ", "a man walks", "avocado"), ("av", "plain", None, None, "avocado"), ("av", "plain", None, None, "unknown")]
    df = spark.createDataFrame(rows, "m string, raw string, a string, v string, model string")
    got = [r[0] for r in df.select(json_text.caption_of(*map(F.col, ("m", "raw", "a", "v", "model")))).collect()]
    assert got[0].status == "merged" and "sad" not in got[0].audio_description and got[0].visual_description == "a man walks"
    assert got[1].status == "normalized" and got[1].confidence == "low" and [g.confidence for g in got[2:]] == ["medium", "low"]


def test_window_scan(spark):
    def reply(prompt):
        return {"a": "from 2 to 6 seconds", "b": "Not present here", "c": "from 1 to 99 seconds"}[prompt[-1]]

    q = spark.createDataFrame([("1", "a", 20.0), ("2", "b", 20.0), ("3", "c", 20.0), ("4", "a", 2.0)], "query_id string, query_text string, duration double").withColumn("clip_path", F.lit(None).cast("string"))
    got = {r.query_id: tuple(r)[1:] for r in stages.window_scan(q, lambda: FakeClient(reply), 10.0, 9.0).collect()}
    assert got == {"1": (2, 6, 1, 2, 2), "2": (None, None, 0, 2, 0), "3": (1, 20, 2, 2, 2), "4": (None, None, 0, 0, 0)}


def test_placeholders_and_variants(spark, tmp_path):
    c = spark.createDataFrame([("v", "s001", 1, "b"), ("v", "s001", 0, "a"), ("v", "s009", 2, "z")], "video_id string, segment_id string, pos int, emotion string")
    s = spark.createDataFrame([("v", "s001"), ("v", "s002")], "video_id string, segment_id string")
    assert {r.segment_id: r.emotion for r in stages.with_placeholders(c, s).collect()} == {"s001": "a", "s002": "neutral"}
    for v in ("p0", "p1"):
        (tmp_path / f"{v}_quality.txt").write_text(f"ask {v}")
    rows = prompts.prompt_variants(spark, str(tmp_path), ["p0", "p1"], ["quality"]).collect()
    assert [tuple(r) for r in rows] == [("p0", "quality", "ask p0"), ("p1", "quality", "ask p1")]


def scrubbed_plainly(x):
    for pattern, new in text.SCRUB:
        x = x if x is None else re.sub(pattern, new.replace("$", "\\"), x)
    return x


def test_scrub_whole_texts(spark):
    rows = [None, "", "sad", "A sad, low voice", "an, apple and éan, apple", "Léan, un; a, très; ean , x", "Élan showing some fear. Next, clearly expressing anger; end", "x " * 5000 + "very tense and", "  A crowd,\nof angry , men ;. or"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    got = [r.c for r in df.select("i", text.scrubbed(F.col("x")).alias("c")).orderBy("i").collect()]
    assert got == [scrubbed_plainly(x) for x in rows]


def test_contiguity_of_long_conversations(spark, tmp_path):
    import duckdb

    from spanforge.plans import registry

    rows = [(1, i, "user" if i > 60 else "assistant", "x") for i in range(1, 81)] + [(2, i, "user", "x") for i in (0, 1, 2)] + [(3, i, "user", "x") for i in (1100, 1102)] + [(4, 999, "user", "x"), (4, 1000, "user", "x"), (None, 70, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.role, r.ok) for r in registry.queries()["contiguity_check"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == set(con.execute(registry.oracle_sql()["contiguity_check"]).fetchall())
    assert {(1, "user", True), (2, "user", False), (3, "user", False), (4, "user", True)} <= got


def test_every_pair_of_similar_texts(spark):
    from spanforge.operators import quality

    rows = [(k, i, x) for k in (0, 1) for i, x in enumerate(("a b", "b a", "a b c", "d", "A b", "", "c d"))]
    want = {(k, i, j) for k, i, x in rows for h, j, y in rows if k == h and i < j and x and y and len(set(x.lower().split()) & set(y.lower().split())) / max(len(x.split()), len(y.split())) >= 0.5}
    got = quality.all_similar_pairs(spark.createDataFrame(rows, "k long, i long, x string"), "k", "i", "x", 0.5).collect()
    assert {(r.k, r.a, r.b) for r in got} == want and len(got) == len(want)


def test_spans_are_merged_within_a_row(spark):
    from spanforge.functions import spans
    from spanforge.operators import batches

    h = "array<array<double>>"
    rows = spark.createDataFrame([([[15.0, 21.0], [5.0, 9.0], [10.0, 15.0], [20.0, 20.5], [40.0, 41.0]],), ([],)], f"h {h}")
    assert [r.m for r in rows.select(spans.merged("h").alias("m")).collect()] == [[[5.0, 9.0], [10.0, 21.0], [40.0, 41.0]], []]
    said = spark.createDataFrame([("a", False, [[0.0, 4.0], [4.0, 8.0]], [0.0, 8.0]), ("b", False, None, [1.0, 2.0])], f"query_id string, not_groundable boolean, human_time_ranges {h}, model_time_range array<double>")
    new = spark.createDataFrame([("a", [0.0, 4.0])], "query_id string, time_range array<double>")
    got = batches.reground_compared(said, new)
    assert got.first()[:4] == (2, 1.0, 0.75, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_predictions_and_streams_are_written_by_many_tasks(spark, monkeypatch):
    import __spark_entry__ as entry
    from pyspark.sql import DataFrame

    def refused(self, n):
        raise AssertionError("one task for all rows")

    monkeypatch.setattr(DataFrame, "coalesce", refused)
    assert entry.queries()["predictions_read"](spark, "/root/testdata/sf0.001").count() > 0
    assert entry.queries()["stream_islands"](spark, "/root/testdata/sf0.001").count() > 0


def test_model_calls_are_dealt_over_tasks(spark):
    from spanforge.sources.model import FakeClient, model_stage

    work = spark.range(400).coalesce(1).selectExpr("cast(id as string) key", "'x' prompt", "cast(array() as array<string>) media")
    said = model_stage(work, lambda: FakeClient(lambda p: p))
    assert said.rdd.getNumPartitions() > 1 and said.count() == 400
