"""Registered queries of annotations, citations, judges' replies and window scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_text, text, verdicts
from ..operators import annotations, citations, evals, stages, stats
from ..sources.model import FakeClient
from .registry import query


def _annotations(t):
    i = F.col("doc_id")
    label = lambda k: F.element_at(F.array(F.lit("pass"), F.lit("fail"), F.lit("pass"), F.lit("skip"), F.lit(None)), (F.floor(i / k) % 5 + 1).cast("int"))
    return t("documents").select(
        (i % 40).alias("video_id"),
        i.alias("query_id"),
        i.alias("pos"),
        F.lit("").alias("query_type"),
        F.when(i % 2 == 0, F.concat(F.lit("q"), i)).alias("final_query_text"),
        F.when(i % 5 != 0, F.concat(F.lit("first "), i)).alias("initial_query_text"),
        F.transform(F.sequence(F.lit(0).cast("long"), i % 3), lambda j: F.format_string("s%03d", (i * 7 + j) % 12 + 1)).alias("segment_ids"),
        F.when(i % 4 != 0, F.format_string("about (%d-%.1fs)", i % 50, (i % 50).cast("double") + 4.5)).alias("approximate_time"),
        *[label(k).alias(c) for k, c in ((1, "human_emotion_relevant"), (5, "human_answerability"), (25, "human_query_quality"))],
    )


_LABEL = "['pass', 'fail', 'pass', 'skip', NULL][(doc_id // {}) % 5 + 1]"
_LABELLED = f"(SELECT doc_id, {_LABEL.format(1)} AS a, {_LABEL.format(5)} AS b, {_LABEL.format(25)} AS c FROM documents)"
_TEXT = "CASE WHEN doc_id % 2 = 0 THEN 'q' || doc_id WHEN doc_id % 5 <> 0 THEN 'first ' || doc_id ELSE '' END"


@query(f"SELECT doc_id AS query_id, {_TEXT} AS query_text, CASE WHEN whole THEN CASE WHEN NOT (a = 'pass' AND b = 'pass') THEN 'fail' WHEN c = 'fail' THEN 'revise' ELSE 'pass' END END AS gold_decision FROM (SELECT *, coalesce(a IN ('pass', 'fail') AND b IN ('pass', 'fail') AND c IN ('pass', 'fail'), false) AS whole FROM {_LABELLED})")
def annotation_gold(t):
    return annotations.gold(_annotations(t)).select("query_id", "query_text", "gold_decision")


@query(
    """WITH a AS (SELECT doc_id, unnest(range(0, doc_id % 3 + 1)) AS j FROM documents), n AS (SELECT doc_id, min((doc_id * 7 + j) % 12 + 1) AS lo, max((doc_id * 7 + j) % 12 + 1) AS hi FROM a GROUP BY doc_id)
SELECT doc_id AS query_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 50 ELSE (lo - 1) * 5 END::DOUBLE AS "start", CASE WHEN doc_id % 4 <> 0 THEN doc_id % 50 + 4.5 ELSE hi * 5 END::DOUBLE AS "end" FROM n"""
)
def annotation_queries(t):
    return annotations.annotated_queries(_annotations(t)).select("query_id", F.col("time_range")[0].alias("start"), F.col("time_range")[1].alias("end"))


@query(
    """WITH a AS (SELECT doc_id, unnest(range(0, doc_id % 3 + 1)) AS j FROM documents), c AS (SELECT doc_id % 40 AS v, (doc_id * 7 + j) % 12 + 1 AS n, doc_id % 50 AS s, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN doc_id END AS x FROM a)
SELECT v AS video_id, format('s{:03d}', n) AS segment_id, n::INT AS "index", coalesce(arg_max(s, x), (n - 1) * 5)::DOUBLE AS start_time, coalesce(arg_max(s, x) + 4.5, n * 5)::DOUBLE AS end_time FROM c GROUP BY v, n"""
)
def annotation_segments(t):
    return annotations.annotated_segments(_annotations(t)).drop("clip_path")


@query(
    """WITH e AS (SELECT event_id AS i, user_id AS v FROM events WHERE event_id % 10 <> 0),
g AS (SELECT v, n FROM (SELECT DISTINCT user_id AS v FROM events), range(1, 13) r(n) WHERE (v + n) % 5 <> 0),
c AS (SELECT i, min(n) AS lo, max(n) AS hi FROM e JOIN g ON e.v = g.v AND i % 3 <> 0 AND n IN (i % 14 + 1, i % 9 + 1) GROUP BY i),
r AS (SELECT e.i, g.n FROM e JOIN g ON e.v = g.v LEFT JOIN c ON c.i = e.i WHERE CASE WHEN lo IS NOT NULL THEN n BETWEEN lo AND hi ELSE (n - 1) * 5 < e.i % 70 + 6 AND e.i % 70 < n * 5 END)
SELECT i AS event_id, count(*) AS n, (min(n) - 1) * 5::DOUBLE AS "start", max(n) * 5::DOUBLE AS "end" FROM r GROUP BY i"""
)
def events_on_citations(t):
    i = F.col("event_id")
    cue = lambda k: F.when(i % 3 != 0, F.array(F.format_string(" [s%03d] a cue", i % k + 1), F.lit("no place"))).otherwise(F.array(F.lit("x [s001]")))
    none = F.lit(None).cast("string")
    events = t("events").select(F.col("user_id").alias("video_id"), i.alias("pos"), i.cast("string").alias("event_id"), F.array((i % 70).cast("double"), (i % 70 + 6).cast("double")).alias("time_range"), cue(14).alias("visual_evidence"), cue(9).alias("audio_evidence"), F.when(i % 10 == 0, "LOW").alias("confidence"), none.alias("evidence_strength"), none.alias("target_person"), none.alias("target_person_or_group"))
    n = F.col("n")
    segments = t("events").select(F.col("user_id").alias("video_id")).distinct().select("video_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n")).where("(video_id + n) % 5 <> 0")
    segments = segments.select("video_id", F.format_string("s%03d", n).alias("segment_id"), ((n - 1) * 5.0).alias("start_time"), (n * 5.0).alias("end_time"))
    got = citations.set_on_citations(events, segments)
    return got.select(F.col("pos").alias("event_id"), F.size("segment_ids").cast("long").alias("n"), F.col("time_range")[0].alias("start"), F.col("time_range")[1].alias("end"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'missing/invalid dimension: coverage' WHEN 1 THEN 'response is not a JSON object' END AS problem, CASE WHEN event_id % 4 <> 1 THEN event_id % 5 + 1 END AS faithfulness, CASE WHEN event_id % 4 <> 1 THEN 1 END AS leak FROM events")
def caption_verdicts(t):
    i = F.col("event_id")
    whole = F.format_string('{"faithfulness":{"score":"%d","reason":"r"},"hallucination":{"score":3.9},"coverage":{"score":%d},"fluency":{"score":5},"emotion_leakage_ok":{"score":true}} bye', i % 5 + 1, F.when(i % 4 == 0, 9).otherwise(2))
    v = verdicts.caption_verdict(F.when(i % 4 == 1, "none").otherwise(whole))
    return t("events").select("event_id", v["parse_error"].alias("problem"), v["faithfulness"]["score"].cast("long").alias("faithfulness"), v["emotion_leakage_ok"]["score"].alias("leak"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_type = 'click')::INT END AS same FROM events")
def event_verdicts(t):
    said = F.when(F.col("event_id") % 4 == 0, F.lit("7")).otherwise('" Click "')
    raw = F.concat(F.lit('<think>{}</think>{"cue_sufficiency":{"score":1},"cue_grounded":{"score":2},"label_agreement":{"agree":true,"predicted_label":'), said, F.lit("}}"))
    return t("events").select("event_id", verdicts.event_verdict(raw, F.col("event_type"))["label_agreement"]["score"].alias("same"))


@query("SELECT count(*) FILTER (WHERE bad AND NOT seen) AS tp, count(*) FILTER (WHERE bad AND seen) AS fn, count(*) FILTER (WHERE NOT bad AND NOT seen) AS fp, count(*) FILTER (WHERE NOT bad AND seen) AS tn FROM (SELECT conv_id, conv_id % 3 = 0 AS bad, bool_or((conv_id + turn) % 4 = 0) AS seen FROM conversations GROUP BY conv_id)")
def cue_confusion(t):
    replies = t("conversations").select("conv_id", F.when(F.col("conv_id") % 3 == 0, "HALLUC").otherwise("GOOD").alias("label"), F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, " YES, it is").otherwise("No, yes").alias("reply"))
    return evals.cue_confusion(evals.cue_check(replies, "conv_id", "label"), "label")


_PART = "SELECT '{1}' AS part, {0} AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM {2} GROUP BY 2"


@query(_PART.format("CASE WHEN quality = 1 THEN 'accepted' ELSE 'discarded' END", "final_status", "labels") + " UNION ALL " + _PART.format("CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'revise' END", "decision", "events"))
def evaluation_summary(t):
    traces = t("labels").select(F.when(F.col("quality") == 1, "accepted").otherwise("discarded").alias("final_status"))
    rounds = t("events").select(F.element_at(F.array(*map(F.lit, ("pass", "fail", "revise"))), (F.col("event_id") % 3 + 1).cast("int")).alias("decision"))
    return stats.evaluation_summary(traces, rounds)


@query("WITH g AS (SELECT c_custkey, (c_custkey % 97)::DOUBLE / 2 AS d, unnest(range(0, ceil((c_custkey % 97) / 10.0)::BIGINT)) AS i FROM customer) SELECT c_custkey, string_agg(format('s{:03d}: {}-{}s', i, i * 5, round_even(least((i + 1) * 5, d), 0)::BIGINT), chr(10) ORDER BY i) AS grid FROM g GROUP BY c_custkey")
def grid_lines(t):
    return t("customer").where("c_custkey % 97 > 0").select("c_custkey", text.grid_lines((F.col("c_custkey") % 97) / 2.0).alias("grid"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a hum' ELSE 'clicks' END AS audio, CASE WHEN event_id % 3 = 0 THEN 'merged' ELSE 'normalized' END AS status, CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'high' END AS confidence FROM events")
def captions_by_model(t):
    both = F.col("event_id") % 3 == 0
    c = json_text.caption_of(F.when(both, "audio_video").otherwise("av"), F.lit('{"visual":"v","audio":"clicks","confidence":"high"}'), F.lit(" a hum "), F.lit("a man walks"), F.lit("avocado"))
    return t("events").select("event_id", c["audio_description"].alias("audio"), c["status"].alias("status"), c["confidence"].alias("confidence"))


def _scan_reply(prompt: str) -> str:
    n = sum(map(ord, prompt))
    return "It is NOT present." if n % 3 == 0 else f"From {n % 11} to {n % 11 + 4} seconds"


@query()
def window_scan_fake(t):
    rows = t("customer").select(F.col("c_custkey").cast("string").alias("query_id"), F.concat(F.lit("event "), "c_custkey").alias("query_text"), (F.col("c_custkey") % 97).cast("double").alias("duration"), F.lit("clip").alias("clip_path"))
    return stages.window_scan(rows, lambda: FakeClient(_scan_reply))
