import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanforge.operators import stats
from spanforge.sources import catalog, committed, records, runs

SEGMENTS = [("v1", "s001", 1, 0.0, 5.0, "clips/v1/s001.mp4"), ("v1", "s002", 2, 5.0, 10.0, None), ("v2", "s001", 1, 0.0, 5.0, None)]


def final(spark, rows):
    return catalog.conformed(spark.createDataFrame(rows, "video_id string, query_id string, final_query_text string"), catalog.FINAL)


def short(df):
    return sorted((r.video_id, r.query_id, r.final_query_text) for r in df.collect())


def test_later_run_takes_over_whole_videos(spark, tmp_path):
    first = [("v1", "q1", "a"), ("v1", "q2", "a"), ("v 2/ü", "q1", "a")]
    later = [("v1", "q3", "b"), ("v3", "q1", "b")]
    want = [("v 2/ü", "q1", "a"), ("v1", "q3", "b"), ("v3", "q1", "b")]
    store = runs.VideoStore(spark, str(tmp_path / "store"))
    assert store.table("final").count() == 0
    for k, rows in enumerate((first, later, later)):  # repeating a replacement changes nothing
        store.replace({"final": final(spark, rows)})
        if k < 2:
            catalog.write_run({"final": final(spark, rows)}, str(tmp_path / f"run{k}"))
    assert short(store.table("final")) == want
    assert store.table("final").schema == catalog.FINAL
    folders = [str(tmp_path / f"run{k}") for k in (0, 1)]
    assert short(catalog.merged_runs(spark, folders, "final")) == want
    assert short(catalog.merged(spark, folders, str(tmp_path / "into"))["final"]) == want
    with pytest.raises(Exception, match="a row without a video"):
        store.replace({"final": final(spark, [(None, "q1", "a")])})


def test_a_store_has_no_folder_a_video(spark, tmp_path):
    store = runs.VideoStore(spark, str(tmp_path / "store"))
    many = spark.range(600).select(F.concat(F.lit("v"), "id").alias("video_id"), F.lit("q1").alias("query_id"), F.lit("a").alias("final_query_text"))
    store.replace({"final": many})
    store.replace({"final": many.where("video_id like 'v1%'").withColumn("final_query_text", F.lit("b"))})
    assert len(list(tmp_path.rglob("*"))) < 60
    assert short(store.table("final")) == sorted((f"v{i}", "q1", "b" if str(i)[0] == "1" else "a") for i in range(600))


def test_a_store_is_written_anew_after_some_parts(spark, tmp_path):
    # a table with a folder a video, as earlier versions left it
    final(spark, [("v0", "q0", "old"), ("v 9/ü", "q0", "old")]).write.partitionBy("video_id").parquet(str(tmp_path / "final"))
    store = runs.VideoStore(spark, str(tmp_path), most=3)
    want = {"v0": [("v0", "q0", "old")], "v 9/ü": [("v 9/ü", "q0", "old")]}
    assert short(store.table("final")) == sorted(sum(want.values(), []))
    for k in range(8):
        new = {v: [(v, f"q{i}", f"{k}") for i in range(1 + k % 2)] for v in (f"v{k % 3}", f"v{k}")}
        want |= new
        if k == 5:  # a write that fails leaves the table as it was
            with pytest.raises(Exception, match="a row without a video"):
                store.replace({"final": final(spark, [("v0", "q1", "lost"), ("", "q1", "lost")])})
        store.replace({"final": final(spark, sum(new.values(), []))})
        assert short(store.table("final")) == sorted(sum(want.values(), []))
        assert len(list(Path(tmp_path, "final").glob("part-*"))) <= 4 and (k < 2 or not list(Path(tmp_path, "final").glob("video_id=*")))
    assert store.table("final").schema == catalog.FINAL


def test_nested_files_of_a_run(spark, tmp_path):
    folder = str(tmp_path / "run")
    segments = spark.createDataFrame(SEGMENTS, records.SEGMENT)
    queries = catalog.conformed(spark.createDataFrame([("v1", "q2", "b"), ("v1", "q1", "a")], "video_id string, query_id string, query_text string"), records.QUERY)
    verdicts = catalog.conformed(spark.createDataFrame([("v1", "q1", 1, "fail"), ("v1", "q1", 2, "pass"), ("v1", "q2", 1, "pass")], "video_id string, query_id string, round_index int, decision string"), records.VERDICT)
    prompts = {"verification_prompt.txt": "PROMPT VERSION: v3\nCheck.", "rewrite_prompt.txt": "Rewrite."}
    catalog.write_run({"segments": segments, "queries": queries, "verdicts": verdicts}, folder, {"total_videos": 2}, prompts)
    lines = {r["video_id"]: r for r in map(json.loads, "".join(p.read_text() for p in Path(folder, "initial_queries.jsonl").glob("part-*")).splitlines())}
    assert [q["query_id"] for q in lines["v1"]["queries"]] == ["q1", "q2"] and lines["v2"]["queries"] == []
    rounds = [json.loads(x) for p in Path(folder, "verification_rounds.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted((r["video_id"], r["round_index"], [x["query_id"] for x in r["results"]]) for r in rounds) == [("v1", 1, ["q1", "q2"]), ("v1", 2, ["q1"])]
    back = catalog.read_run(spark, folder)
    for name, df in (("segments", segments), ("queries", queries), ("verdicts", verdicts)):
        assert sorted(map(str, back[name].select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert back["events"].count() == 0
    assert catalog.read_document(spark, f"{folder}/pipeline_stats.json") == {"total_videos": 2}
    assert catalog.read_document(spark, f"{folder}/prompts_used/prompts_manifest.json") == {"verification_prompt.txt": "v3", "rewrite_prompt.txt": "rewrite_prompt.txt"}


def test_stage_folders(spark, tmp_path):
    segments = spark.createDataFrame(SEGMENTS, records.SEGMENT)
    captions = catalog.conformed(segments.select("video_id", "segment_id", F.lit("x").alias("visual_description")), records.CAPTION)
    raw = segments.select("segment_id", F.lit("{}").alias("raw"))
    one, two, three = (str(tmp_path / n) for n in ("captions", "queries", "final"))
    by_video = spark.createDataFrame([("v1", 1, 2.26), ("v2", 0, 1.0)], "video_id string, num_cached int, seconds double")
    metadata = runs.run_metadata("m", "av", segments, captions, by_video, 3.28, segment_seconds=5)
    assert metadata["per_video"][0] == {"video_id": "v1", "num_segments": 2, "num_cached": 1, "seconds": 2.3}
    runs.save_captions(one, raw, captions, segments, metadata)
    got_segments, got_captions = runs.load_captions(spark, one)
    assert got_segments.count() == 3 and sorted(got_captions.collect()) == sorted(captions.collect())
    assert catalog.read_document(spark, f"{one}/run_metadata.json")["num_captions"] == 3
    events = catalog.conformed(spark.createDataFrame([("v1", "e1", "sadness")], "video_id string, event_id string, emotion_label string"), records.EVENT)
    queries = catalog.conformed(spark.createDataFrame([("v1", "q1", "a")], "video_id string, query_id string, query_text string"), records.QUERY)
    runs.save_generation(two, events, queries, segments, {"n": 1})
    back = runs.load_generation(spark, two)
    assert back["events"].select(events.columns).collect() == events.collect()
    assert back["queries"].select(queries.columns).collect() == queries.collect()
    # one document, as a single process leaves it
    Path(two, "one").mkdir()
    Path(two, "one", "generated_queries.json").write_text(json.dumps({"video_id": "v9", "queries": [{"query_id": "q7"}, {"video_id": "v9", "query_id": "q8"}]}, indent=2))
    found = runs.load_generation(spark, f"{two}/one")["queries"].collect()
    assert [(r.video_id, r.query_id) for r in found] == [("v9", "q7"), ("v9", "q8")]
    runs.save_evaluation(three, final(spark, [("v1", "q1", "a")]), {"accepted": 1}, {})
    rows, summary = runs.load_evaluation(spark, three)
    assert short(rows) == [("v1", "q1", "a")] and summary == {"accepted": 1}


def test_statistics_document(spark):
    t = spark.createDataFrame([("v", "q1", "accepted", "a", 1), ("v", "q2", "discarded", "b", 0)], "video_id string, query_id string, final_status string, query_type string, rewrite_count int")
    verdicts = spark.createDataFrame([(1, "pass"), (1, "fail")], "round_index int, decision string")
    events = spark.createDataFrame([("sadness",)], "emotion_label string")
    one = stats.run_stats(t, t, events, t, t, verdicts)
    doc = runs.stats_document(one, ["WARNING: few types", "note"], changed=2)
    assert doc["total_accepted_queries"] == 1 and doc["discarded_query_count"] == 1 and doc["emotion_distribution"] == {"sadness": 1}
    assert doc["diversity_warnings"] == ["WARNING: few types"] and doc["regrounding_changed_count"] == 2
    assert doc["pass_rate_after_rewrites"] == 0.5
    assert len(doc) == 18


SCHEMA = "k long, m map<string,double>, s struct<a:int,b:array<string>>, d date, t timestamp, n decimal(10,2)"


def typed(spark, n):
    return spark.range(n).repartition(3).selectExpr("id AS k", "map('x', id / 2) AS m", "named_struct('a', cast(id AS int), 'b', array('é', null)) AS s", "date'2020-01-02' AS d", "timestamp'2020-01-02 03:04:05.678' AS t", "cast(id AS decimal(10,2)) AS n")


def test_committed_rows_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    assert committed.read(spark, path, SCHEMA).count() == 0 and committed.state(path) is None
    committed.write(typed(spark, 5), path, note="first")
    assert sorted(map(str, committed.read(spark, path, SCHEMA).collect())) == sorted(map(str, typed(spark, 5).collect()))
    committed.write(typed(spark, 2), path, "append")
    assert committed.read(spark, path, SCHEMA).count() == 7
    committed.write(typed(spark, 3), path)
    assert committed.read(spark, path, SCHEMA).count() == 3 and sum(f["rows"] for f in committed.state(path)["files"]) == 3
    assert committed.clean(path) > 0 and committed.read(spark, path, SCHEMA).count() == 3
    committed.write(typed(spark, 0), path)
    assert committed.read(spark, path, SCHEMA).count() == 0


def test_a_dead_task_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    committed.write(spark.range(4), path)
    dies = spark.range(0, 100, 1, 4).selectExpr("CASE WHEN id = 77 THEN raise_error('dead') ELSE id END AS id")
    with pytest.raises(Exception, match="dead"):
        committed.write(dies, path)
    assert sorted(r.id for r in committed.read(spark, path, "id long").collect()) == [0, 1, 2, 3]
    held = {f["file"] for f in committed.state(path)["files"]}
    assert {p.name for p in Path(path, "data").iterdir()} == held  # the abort took its files along


def test_a_dead_commit_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    committed.write(spark.range(4), path)
    writer = committed.CommittedWriter({"path": path}, True)
    name = f"{writer.version}-000000-0-x.json"
    Path(path, "data", name).write_text('{"id": 9}\n')
    system = committed.store_of(path)[0]

    class Dying:
        def __getattr__(self, name):
            return getattr(system, name)

        def move(self, *a):
            raise OSError("dead")

    monkeypatch.setattr(committed, "store_of", lambda p: (Dying(), p))
    with pytest.raises(OSError, match="dead"):
        writer.commit([committed.Written(name, 1, 9)])
    monkeypatch.undo()
    assert committed.read(spark, path, "id long").count() == 4
    writer.abort([None])
    assert name not in {p.name for p in Path(path, "data").iterdir()}
    committed.write(spark.range(2), path)
    assert committed.read(spark, path, "id long").count() == 2


def test_a_document_is_never_missing(spark, tmp_path):
    path = str(tmp_path / "stats.json")
    catalog.write_document(spark, path, {"n": 1})
    with pytest.raises(AttributeError):
        catalog.write_text(spark, path, None)
    assert catalog.read_document(spark, path) == {"n": 1}
    catalog.write_document(spark, path, {"n": 2})
    assert catalog.read_document(spark, path) == {"n": 2}
    assert not list(tmp_path.glob("*.tmp"))
