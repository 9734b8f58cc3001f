import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanforge.functions import domains, json_text, spans, text
from spanforge.operators import evals, intervals, quality, ranking, stages, stats
from spanforge.sources import model, prompts, records
from spanforge.streaming import captions


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)) if schema.startswith("i int") and not isinstance(rows[0], tuple) else [(i, *r) for i, r in enumerate(rows)], schema).orderBy("i").select(column).collect()]


def pairs(rows):
    return [tuple(r) for r in rows]


def test_grid(spark):
    df = spark.createDataFrame([("a", 13.0), ("b", 12.5), ("c", 10.02), ("d", 0.5), ("e", 0.0), ("f", None)], "video_id string, duration double")

    def plan(v, w, s):
        return [(r.start_time, r.end_time) for r in spans.plan_segments(df.where(F.col("video_id") == v), w, s).orderBy("index").collect()]

    assert plan("a", 5, 5) == [(0, 5), (5, 10), (10, 13)]
    assert plan("b", 5, 2.5) == [(0, 5), (2.5, 7.5), (5, 10), (7.5, 12.5), (10, 12.5)]
    assert plan("c", 5, 5) == [(0, 5), (5, 10)]
    assert plan("d", 5, 5) == plan("e", 5, 5) == plan("f", 5, 5) == []
    assert spans.plan_segments(df, 5, 5).where("video_id = 'a'").orderBy("index").first().segment_id == "s001"


@pytest.mark.parametrize("window,stride", [(5.0, 5.0), (5.0, 2.5), (3.0, 4.0)])
def test_grid_against_a_loop(spark, window, stride):
    rng = random.Random(7)
    durations = [round(rng.uniform(0, 40), 2) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(durations)), "i int, d double")
    for r in df.select("d", spans.grid(F.col("d"), window, stride).alias("g")).collect():
        want, start = [], 0.0
        while start < r.d - 1e-6:
            stop = start + window
            want.append((round(start, 6), round(min(stop, r.d), 6)))
            if stop > r.d + 1e-6:
                break
            start += stride
        assert [(g.start, g.end) for g in r.g] == want


def test_spans(spark):
    one = spark.range(1)
    L = F.lit  # noqa: N806
    none = L(None).cast("double")
    got = one.select(
        spans.iou(L(0), L(10), L(5), L(15)), spans.iou(L(0), L(5), L(5), L(10)), spans.iou(L(0), L(5), none, none), spans.iou(L(3), L(3), L(3), L(3)),
        spans.cells(L(4.0), L(6.0), L(60.0)), spans.cells(L(5.0), L(10.0), L(60.0)), spans.jaccard(spans.cells(L(0.0), L(10.0), L(60.0)), F.array(L(1))),
        spans.clamp(L(-1), L(5)), spans.clamp(none, L(5)), spans.max_iou(F.array(L(0.0), L(10.0)), F.array(F.array(L(20.0), L(30.0)), F.array(L(0.0), L(5.0)))), spans.grid_key(L(5), L(5)),
        spans.clip_name(L("s001"), L(0), L(0.0), L(5.0)),
    ).first()
    assert tuple(got) == (pytest.approx(1 / 3), 0, 0, 0, [0, 1], [1], 0.5, 0, None, 0.5, "win5.00_str5.00", "s001_000_0.00_5.00.mp4")


def test_cells_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(round(a, 1), round(a + rng.uniform(0.1, 25), 1), 70.0) for a in (rng.uniform(0, 60) for _ in range(300))]
    df = spark.createDataFrame(rows, "s double, e double, d double")
    for r in df.select("*", spans.cells(F.col("s"), F.col("e"), F.col("d")).alias("c")).collect():
        want = [i for i in range(14) if i * 5 < r.e and (i + 1) * 5 > r.s and min(r.e, i * 5 + 5) - max(r.s, i * 5) >= min(5, r.e - r.s) / 2]
        assert r.c == (want or [int(min(r.s // 5, 13))])


def test_islands_unions_and_clusters_against_loops(spark):
    rng = random.Random(2)
    rows = []
    for v in range(40):
        for p in range(rng.randint(1, 25)):
            s = rng.randint(0, 60)
            rows.append((v, p, s, s + rng.randint(0, 9), rng.choice("ab")))
    df = spark.createDataFrame(rows, "v int, pos int, start int, end int, label string")
    for gap in (0, 3):
        got = {(r.v, r.pos): r.island for r in intervals.islands(df, "v", "start", "end", ["start", "pos"], [F.col("label")], F.lit(gap)).collect()}
        for v in range(40):
            island, last = -1, None
            for _, p, s, e, label in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
                if last and last[0] == label and s - last[1] <= gap:
                    last = (label, max(last[1], e))
                else:
                    island, last = island + 1, (label, e)
                assert got[v, p] == island
    union, best = {}, {}
    for v in range(40):
        own = sorted((s, e) for w, _, s, e, _ in rows if w == v)
        merged, groups = [], []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
            if groups and s <= groups[-1][-1][1]:
                groups[-1].append((s, e))
            else:
                groups.append([(s, e)])
        union[v] = sorted(map(tuple, merged))
        g = max(groups, key=lambda g: (len(g), max(e for _, e in g) - g[0][0]))
        best[v] = (g[0][0], max(e for _, e in g), len(g))
    for r in intervals.span_union(df, "v").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("u")).collect():
        assert pairs(r.u) == union[r.v]
    assert {r.v: (r.start, r.end, r.support) for r in intervals.cluster_vote(df, "v").collect()} == best


def test_folded_events(spark):
    rows = [("v", 1, "angry", "x", 10.0, 15.0, ["a"], "medium", "ambiguous"), ("v", 2, "angry", "", 15.0, 20.0, ["b", "a"], "high", "clear"), ("v", 3, "angry", "y", 19.0, 21.0, None, "high", "weak"), ("v", 4, "sad", "z", 21.0, 22.0, [], "low", "weak")]
    df = spark.createDataFrame(rows, "video_id string, pos int, label string, description string, start double, end double, evidence array<string>, confidence string, evidence_strength string")
    e = intervals.fold_events(intervals.islands(df, "video_id", "start", "end", ["start", "pos"], [F.col("label")], F.lit(5.0)), "video_id").orderBy("island").collect()
    assert tuple(e[0]) == ("v", 0, 10.0, 21.0, "angry", "x y", ["a", "b"], "high", "clear", 3)
    assert e[1].label == "sad" and e[1].description == "z"


def test_resolving_keeps_or_drops(spark):
    items = spark.createDataFrame([("v", "q1", 4.0, 11.0), ("v", "q2", 50.0, 60.0)], "video_id string, query_id string, start double, end double")
    segs = spark.createDataFrame([("v", f"s{i:03d}", i, 5.0 * i, 5.0 * i + 5) for i in (2, 0, 1)], "video_id string, segment_id string, index int, start_time double, end_time double")
    kept = {r.query_id: r.segment_ids for r in intervals.resolved(items, segs, "video_id", "query_id", True).collect()}
    assert kept == {"q1": ["s000", "s001", "s002"], "q2": []}
    assert intervals.resolved(items, segs, "video_id", "query_id", False).count() == 1


def test_text(spark):
    cases = {
        "from 3 to 7 seconds": [3, 7], "7 to 7 seconds": None, "1:05 and 1:10": [65, 70], "at 0:30": None, "8 then 2": [2, 8], "no": None, "": None, "1:00:05 - 1:00:09": [3605, 3609], "5 to 5 seconds, 1 2": None, "2.5-4 seconds": [2.5, 4],
    }
    got = values(spark, text.time_span(F.col("x")), list(cases), "i int, x string")
    assert got == list(cases.values())
    one = spark.range(1)
    L = F.lit  # noqa: N806
    r = one.select(
        text.segment_span(L("segments: s003 s004"), L(18.0)), text.word_overlap(L("The man smiles."), L("the man, smiles widely")), text.word_overlap(L(""), L("a")), text.leading_phrase(L("What, is  this?")),
        text.scrubbed(L("a sad, low-pitched voice")), text.scrubbed(L("She gasps, expressing surprise or shock, then runs")), text.scrubbed(L("clean text")), text.scrubbed(L("")), text.scrubbed(L(None).cast("string")),
        text.guardrail_reverts(L("a happy man"), L("a man")), text.guardrail_reverts(L("a man"), L("a tense man")), text.guardrail_reverts(L("a happy man"), L("one Happy man")), text.without_reasoning(L("<think>a</think>b</think> c ")), text.says_yes(L(" Yes.")),
        text.range_in_text(L("s011 (50-54.4s)")), text.cited_segments(L("[s001, s003] then s009")), text.payload(L("a"), L(" ")), text.time_label(F.array(L(1.0), L(2.5))), text.rendered("a {x} {y} {x}", x=L(1), y=L(None).cast("string")), text.not_present(L("Not Present here")),
    ).first()
    assert tuple(r) == ([15, 18], 0.75, 0, "what is", "a low-pitched voice", "She gasps, then runs", "clean text", "", None, True, True, False, "c", True, [50.0, 54.4], ["s001", "s003"], "Visual: a", "1-2.5s", "a 1  1", True)


def test_folded_scenes(spark):
    schema = "i int, s array<struct<timestamp:string,segment_detail_caption:string,storyline:string,acoustics_content:string>>"
    rows = [[("0-2", " runs ", "tense", None), (None, "stops", None, "bang")], [("1", " ", "x", "y")], []]
    assert values(spark, text.folded_scenes(F.col("s")), [(r,) for r in rows], schema) == ["(0-2) runs (Storyline: tense)\nstops (Audio: bang)", None, None]


def test_json(spark):
    rows = ['{"x":true}', '{"x":"true"}', '{"x":1}', "{}", 'no <think>{"x":false}</think> so ```json\n{"x":true} trailing```', "none", None]
    assert values(spark, json_text.strict_true(F.col("r"), "x"), rows, "i int, r string") == [True, False, False, False, True, False, False]
    v = values(spark, json_text.verdict(F.col("r"), "x"), rows[:4], "i int, r string")
    assert [tuple(x) for x in v] == [(True, ""), (False, "invalid format"), (False, "invalid format"), (False, "invalid format")]
    scores = ['"4"', "4.7", "true", '"4.7"', "9", "null", "5", "0", None]
    assert values(spark, json_text.score(F.col("r")), scores, "i int, r string") == [4, 4, 1, None, None, None, 5, None, None]
    lists = ['x [{"a":1},{"a":2}] y', '{"a":3} [1]', "nothing"]
    got = values(spark, json_text.as_list(F.col("r"), "struct<a:int>"), lists, "i int, r string")
    assert [[x.a for x in g] if g else None for g in got] == [[1, 2], [3], None]
    raw = [('{"visual":"v","audio":"a","confidence":"high","evidence_strength":"clear"}', "av"), ("plain", "audio"), ("plain", "video"), ("{broken", "av"), ("", "av"), (None, "av")]
    c = values(spark, json_text.normalized_caption(F.col("r"), F.col("m"), F.lit("medium")), raw, "i int, r string, m string")
    assert [tuple(x) for x in c] == [("v", "a", "high", "clear", "normalized"), ("", "plain", "medium", "ambiguous", "normalized"), ("plain", "", "medium", "ambiguous", "normalized"), ("{broken", "", "low", "weak", "salvaged"), ("", "", "low", "weak", "salvaged"), ("", "", "low", "weak", "salvaged")]
    d = spark.createDataFrame([(True, True, True), (True, True, False), (False, True, True), (True, False, False), (None, True, True)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in d.select(json_text.decision(*map(F.col, "abc"))).collect()] == ["pass", "revise", "fail", "fail", "fail"]


def test_ranking(spark):
    df = spark.createDataFrame([("v", f"q{i}", "accepted" if i != 3 else "discarded") for i in range(11)], "video_id string, query_id string, final_status string")
    lost = {r.query_id for r in ranking.capped(df, "video_id", ["query_id"], 8).where("final_status = 'discarded'").collect()}
    assert lost == {"q3", "q8", "q9"}  # ids sort as strings: q10 comes early
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, pos int, val string")
    assert {r.k: r.val for r in ranking.first_wins(rows, ["k"], "pos").collect()} == {"a": "x", "b": "z"}
    assert {r.k: r.val for r in ranking.last_wins(rows, ["k"], "pos").collect()} == {"a": "y", "b": "z"}
    assert [(r.k, r.pos) for r in ranking.round_robin(rows, "k", ["pos"], 2).collect()] == [("a", 1), ("b", 1)]
    done = ranking.with_missing(rows.where("k = 'a'").select("k", "val"), rows, ["k"], val="none")
    assert sorted(pairs(done.collect())) == [("a", "x"), ("a", "y"), ("b", "none")]
    items = spark.createDataFrame([(1, ["s1", "s9", "s3", "s1"])], "i int, ids array<string>")
    dim = spark.createDataFrame([("s1", "p1"), ("s3", "p3")], "id string, path string")
    assert ranking.looked_up(items, ["i"], "ids", dim, "id", "path").first().paths == ["p1", "p3", "p1"]


def test_violations(spark):
    rows = [("v", f"q{i}", "explicit_event", "accepted", f"Who is the man number{i}") for i in range(4)] + [("v", "q9", "odd", "lost", "x"), ("v", "q8", "explicit_event", "accepted", " "), ("w", "q1", "emotion_state", "accepted", "same"), ("w", "q2", "emotion_state", "accepted", "same"), ("u", "q1", "emotion_state", "discarded", "t")]
    df = spark.createDataFrame(rows, "video_id string, query_id string, query_type string, final_status string, final_query_text string")
    got = {(r.video_id, r.kind) for r in quality.violations(df, most=4).collect()}
    assert got == {("v", "status"), ("v", "type"), ("v", "empty_text"), ("v", "too_many"), ("w", "duplicate_text"), ("w", "few"), ("u", "few"), ("v", "one_type"), ("w", "one_type"), ("v", "same_start"), ("v", "similar"), ("w", "similar")}
    assert quality.violations(df.limit(0)).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(False, False)], "g boolean, p boolean")
    assert tuple(df.agg(*evals.prf(F.col("g"), F.col("p"))).first()) == (0, 0, 0, 0, 0, 0)
    means = spark.createDataFrame([("m", "faithfulness", 4.0), ("m", "hallucination", None), ("m", "fluency", 2.0)], "g string, dim string, mean double")
    assert evals.combined_score(means, "g").first().combined == pytest.approx((0.3 * 4 + 0.15 * 2) / 0.45, abs=1e-6)
    rows = spark.range(2000).select("id", (F.col("id") % 2).cast("double").alias("x"))
    ci = evals.bootstrap(rows, "x", "id", draws=200, low=5, high=195).first()
    assert 0.45 < ci.lo < 0.5 < ci.hi < 0.55
    r = spark.createDataFrame([(evals.NO_VERDICT,), ("x: call failed",), (None,), ("invalid format",)], "failure_reason string")
    assert tuple(evals.format_failures(r).first()) == (0.25, 0.5)


def test_stats_and_maps(spark):
    h = stats.histogram(spark.createDataFrame([("a",), ("a",), ("b",)], "x string"), "x")
    assert sorted(pairs(h.collect())) == [("a", 2, 66.7), ("b", 1, 33.3)]
    assert stats.as_map(h, "x").first().counts == {"a": 2, "b": 1}


def test_records(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"video_id":"v","segment_id":"s001","index":0}\n\n{"segment_id":"s002","index":1,"clip_path":"x/w/s002.mp4"}\n{"segment_id":"s003","clip_path":"x/y.mp4"}\n')
    df = records.read_jsonl(spark, str(p), records.SEGMENT)
    assert df.count() == 3 and records.read_jsonl(spark, str(tmp_path / "no"), records.SEGMENT).count() == 0
    assert {r.segment_id: r.video_id for r in records.repaired(df, ["v", "w"]).collect()} == {"s001": "v", "s002": "w"}
    (tmp_path / "bad.jsonl").write_text('{"video_id": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), records.SEGMENT).collect()
    (tmp_path / "a.json").write_text(json.dumps({"annotations": [{"query_id": "q1", "pred": [1, 2]}, {"query_id": "q2"}]}, indent=1))
    assert records.read_nested(spark, str(tmp_path / "a.json"), records.PREDICTION, "annotations").count() == 2
    raw = [(None,), ("{x",), ('{"segment_id":"s"}',), (json.dumps({"segment_id": "s", "time_range": [0, 1], "visual_description": "", "audio_description": "", "confidence": "low", "evidence_strength": "weak"}),)]
    got = records.cache_state(spark.createDataFrame(raw, "raw string")).collect()
    assert [r.reason for r in got] == ["not_found", "json_parse_error", "missing_required_fields", None]
    records.write_jsonl(df, str(tmp_path / "out"), files=1)
    assert records.read_jsonl(spark, str(tmp_path / "out"), records.SEGMENT).count() == 3
    (tmp_path / "q.jsonl").write_text('{"video_id":"v","queries":[{"query_id":"a"}]}\n{"video_id":"v","queries":[{"query_id":"b"},{"query_id":"c"}]}\n')
    assert sorted(r.query_id for r in records.read_queries_by_video(spark, str(tmp_path / "q.jsonl")).collect()) == ["b", "c"]
    for n in ("a.mp4", "b.MKV", "c.txt"):
        (tmp_path / "vids").mkdir(exist_ok=True)
        (tmp_path / "vids" / n).write_bytes(b"x")
    files = records.list_files(spark, str(tmp_path / "vids"))
    assert [r.video_id for r in records.pick(files, ["b", "a"]).collect()] == ["b", "a"]
    with pytest.raises(FileNotFoundError):
        records.pick(files, ["z"])
    paths = spark.createDataFrame([("out/verify_p3/r.jsonl",), ("out/base/r.jsonl",)], "p string")
    assert [r[0] for r in paths.select(records.label_of(F.col("p"))).collect()] == ["p3", "base"]


def test_prompts(tmp_path):
    (tmp_path / "a.txt").write_text("PROMPT VERSION: 7\n{{include b.txt}}+{{include b.txt}}")
    (tmp_path / "b.txt").write_text("B{{include a.txt}}")
    assert prompts.load_prompt("a.txt", [str(tmp_path)]) == "PROMPT VERSION: 7\nB+"
    assert prompts.version((tmp_path / "a.txt").read_text()) == "7"
    with pytest.raises(ValueError):
        domains.check_inputs("secap", True, False)


def test_model_stage_isolates_failures(spark):
    def answer(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return prompt.upper()

    df = spark.createDataFrame([("1", "a", ["m"]), ("2", "bad", None), ("3", "c", [])], "key string, prompt string, media array<string>")
    got = {r.key: (r.raw, r.error, r.attempts) for r in model.model_stage(df, lambda: model.FakeClient(answer), attempts=2, pause=lambda k: 0).collect()}
    assert got == {"1": ("A", None, 1), "2": (None, "RuntimeError: down", 2), "3": ("C", None, 1)}
    assert [model.retry_delay(k) for k in (1, 2, 9)] == [5, 10, 60]


def test_verify_loop(spark):
    def answer(prompt):
        _, dim, query = prompt.split("\n")
        if query == "fail" and dim == "answerability_pass" or query.startswith(("fix", "blank", "never")) and dim == "query_quality_pass":
            return json.dumps({"pass": False, "reason": "r", "suggested_revision": {"fix": "good", "blank": " ", "never": "never more"}.get(query.split()[0], "")})
        return '{"pass": true}' if query != "mute" else "hm"

    rows = [("v", q, "explicit_event", q) for q in ("good", "fail", "fix", "blank", "never", "mute")]
    df = spark.createDataFrame(rows, "video_id string, query_id string, query_type string, query_text string")
    got = {r.query_id: (r.final_status, r.rewrite_count, len(r.rounds), r.text) for r in stages.verify_loop(df, lambda: model.FakeClient(answer)).collect()}
    assert got == {"good": ("accepted", 0, 1, "good"), "fail": ("discarded", 0, 1, "fail"), "fix": ("accepted", 1, 2, "good"), "blank": ("discarded", 0, 1, "blank"), "never": ("discarded", 2, 3, "never more"), "mute": ("discarded", 0, 1, "mute")}


def test_regrounding_and_matching(spark):
    segs = spark.createDataFrame([("v", f"s{i:03d}", i) for i in range(6)], "video_id string, segment_id string, index int")
    q = spark.createDataFrame([("v", f"q{i}", ["s002"]) for i in range(5)], "video_id string, query_id string, segment_ids array<string>")
    allowed = intervals.candidate_band(q, segs, "video_id", 1)
    assert allowed.first().candidates == ["s001", "s002", "s003"]
    chosen = spark.createDataFrame([("v", "q0", ["s002", "s003"]), ("v", "q1", ["s001", "s003"]), ("v", "q2", ["s005"]), ("v", "q3", [])], "video_id string, query_id string, segment_ids array<string>")
    out = {r.query_id: (r.valid, r.segment_ids, r.gen_segment_ids) for r in stages.reground(q, chosen, segs, allowed).collect()}
    assert out["q0"] == (True, ["s002", "s003"], ["s002"]) and all(out[f"q{i}"] == (False, ["s002"], ["s002"]) for i in (1, 2, 3, 4))
    p = spark.createDataFrame([("g", i, f"s{i}") for i in range(3)], "group string, slot int, segment_id string")
    items = spark.createDataFrame([("g", 0, "s2"), ("g", 1, "zz"), ("g", 2, "s2")], "group string, pos int, claimed_id string")
    assert sorted((r.slot, r.pos) for r in stages.match_items(p, items).collect()) == [(1, 1), (2, 0)]


def test_refined_and_review(spark):
    q = spark.createDataFrame([("q1", "a happy man"), ("q2", "a sad dog"), ("q3", "x")], "query_id string, query_text string")
    r = spark.createDataFrame([("q1", 'so {"supported":true,"query":"a man"}'), ("q2", '{"supported":false}')], "key string, raw string")
    got = {x.query_id: (x.query_text, x._dropped, x._reverted) for x in stages.refined(q, r).collect()}
    assert got == {"q1": ("a happy man", False, True), "q2": ("a sad dog", True, False), "q3": ("x", False, False)}
    t = spark.createDataFrame([Row(video_id="v", query_id="q2", query_type="t", final_status="accepted", final_query_text="b", time_range=[0.0, 5.0]), Row(video_id="v", query_id="q1", query_type="t", final_status="discarded", final_query_text="a", time_range=[0.0, 5.0])])
    assert pairs(records.review_sheet(t).collect()) == [("v", "q2", "t", "b", "0-5s", "", "", "")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{h:02d}:30:00", "kind": "k"}) for h in (0, 0, 1, 5)))
    stream = captions.read_stream(spark, str(src), "ts timestamp_ntz, kind string")
    captions.drain(captions.counts(stream, "ts", "kind"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in got.collect()) == [1, 2]  # the last window is still open


def test_entry_without_training_operators(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 50
