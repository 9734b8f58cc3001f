"""Stages around model calls: captions, events, queries, re-grounding, verification."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains, json_text, spans, text
from ..sources.model import Client, model_stage
from . import intervals, ranking

EVENT = "array<struct<emotion_label:string,event_description:string,time_range:array<double>,target_person_or_group:string,visual_evidence:array<string>,confidence:string,evidence_strength:string>>"
QUERY = "array<struct<query_type:string,query_text:string,time_range:array<double>>>"


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def caption_stage(segments: DataFrame, done: DataFrame | None, client: Callable[[], Client], modality: str = "av", template: str = "Describe {segment_id} ({start}-{end}s).") -> DataFrame:
    """A caption for each segment that ``done`` lacks; unusable replies are salvaged."""
    work = segments if done is None else ranking.pending(segments, done, ["video_id", "segment_id"])
    prompt = text.rendered(template, segment_id=F.col("segment_id"), start=F.col("start_time"), end=F.col("end_time"))
    work = work.withColumns({"key": F.concat_ws("\t", "video_id", "segment_id"), "prompt": prompt, "media": F.array_compact(F.array("clip_path"))})
    # replies are read in the tasks that asked for them: those after a join are few, by bytes
    c = json_text.normalized_caption(F.col("raw"), F.lit(modality), F.lit("low"))
    replies = settled(model_stage(work, client).select("key", c.alias("c"), "error"))
    rows = work.join(replies, "key")
    return rows.select("video_id", "segment_id", F.array("start_time", "end_time").alias("time_range"), "c", "error").select("video_id", "segment_id", "time_range", "c.*", "error")


def caption_payloads(captions: DataFrame) -> DataFrame:
    """(video_id, payload, n): captions of a video as JSON lines in segment order."""
    line = F.to_json(F.struct("segment_id", "time_range", text.payload(F.col("visual_description"), F.col("audio_description")).alias("caption")))
    parts = F.sort_array(F.collect_list(F.struct("segment_id", line.alias("line"))))
    return captions.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("payload"), F.count(F.lit(1)).alias("n"))


def event_stage(captions: DataFrame, segments: DataFrame, client: Callable[[], Client], gap: float, draws: int = 3) -> DataFrame:
    """Emotion events: drawn until a draw keeps under twice the captions (10 at least)
    and the smallest draw otherwise, cut to that ceiling, checked, merged, resolved."""
    p = settled(caption_payloads(captions).withColumn("ceiling", F.greatest(2 * F.col("n"), F.lit(10))))
    drawn, todo = None, p
    for k in range(1, draws + 1):  # only videos without a fitting draw are asked again
        tries = todo.withColumns({"draw": F.lit(k), "key": F.concat_ws("\t", "video_id", F.lit(k)), "prompt": F.concat(F.lit("events\n"), F.col("payload")), "media": F.array().cast("array<string>")})
        told = F.coalesce(F.from_json(json_text.first_array(F.col("raw")), EVENT), F.array().cast(EVENT))
        said = model_stage(tries, client).select("key", told.alias("events"))
        got = settled(tries.select("key", "video_id", "draw", "ceiling").join(said, "key"))
        drawn = got if drawn is None else drawn.unionByName(got)
        todo = todo.join(got.where(F.size("events") > F.col("ceiling")).select("video_id"), "video_id", "left_semi")
        if k < draws and got.where(F.size("events") > F.col("ceiling")).isEmpty():
            break
    n = F.size("events")
    best = drawn.groupBy("video_id").agg(F.min_by(F.struct("events", "ceiling"), F.when(n <= F.col("ceiling"), F.struct(F.lit(0).alias("a"), F.col("draw").alias("b"))).otherwise(F.struct(n.alias("a"), F.col("draw").alias("b")))).alias("x"))
    rows = best.select("video_id", F.posexplode(F.slice("x.events", F.lit(1), F.col("x.ceiling"))).alias("pos", "e")).where(F.col("e.emotion_label").isin(*domains.EMOTIONS))
    rows = rows.select("video_id", "pos", F.format_string("%s_e%02d", "video_id", F.col("pos") + 1).alias("event_id"), F.col("e.emotion_label").alias("label"), F.col("e.event_description").alias("description"), text.target_key(F.col("e.target_person_or_group")).alias("target"), F.when(F.size("e.time_range") == 2, F.col("e.time_range")).alias("r"), F.col("e.visual_evidence").alias("evidence"), F.coalesce("e.confidence", F.lit("low")).alias("confidence"), F.coalesce("e.evidence_strength", F.lit("weak")).alias("evidence_strength"))
    rows = rows.withColumns({"start": F.col("r")[0], "end": F.col("r")[1]})
    timed = intervals.islands(rows.where("r is not null"), "video_id", "start", "end", ["start", "pos"], [F.col("label"), F.col("target")], F.lit(gap))
    merged = intervals.fold_events(timed, "video_id").select("video_id", F.format_string("%s_m%02d", "video_id", F.col("island") + 1).alias("event_id"), "label", "description", "start", "end", "confidence", "evidence_strength")
    apart = rows.where("r is null").select("video_id", "event_id", "label", "description", "start", "end", "confidence", "evidence_strength")
    events = merged.unionByName(apart)
    ids = intervals.resolved(events.select("video_id", "event_id", "start", "end"), segments, "video_id", "event_id", keep_unmatched=True).drop("start", "end")
    return events.join(ids, ["video_id", "event_id"], "left")


def query_stage(captions: DataFrame, events: DataFrame, segments: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """Queries of videos that have captions and events; ids are numbered before rows of
    an unknown type or without a span inside the video are dropped."""
    told = F.to_json(F.sort_array(F.collect_list(F.struct("start", "end", "label", "description"))))
    work = caption_payloads(captions).join(events.groupBy("video_id").agg(told.alias("told")), "video_id")
    work = work.withColumns({"key": F.col("video_id"), "prompt": F.concat(F.lit("queries\n"), "payload", F.lit("\n"), "told"), "media": F.array().cast("array<string>")})
    said = settled(model_stage(work, client).select("key", F.from_json(json_text.first_array(F.col("raw")), QUERY).alias("said")))
    raw = said.select(F.col("key").alias("video_id"), F.posexplode("said").alias("pos", "q"))
    stop = segments.groupBy("video_id").agg(F.max("end_time").alias("stop"))
    rows = raw.join(stop, "video_id").withColumns({"start": spans.clamp(F.col("q.time_range")[0], F.col("stop")), "end": spans.clamp(F.col("q.time_range")[1], F.col("stop"))})
    rows = rows.where(F.col("q.query_type").isin(*domains.QUERY_TYPES) & (F.size("q.time_range") == 2) & spans.valid_span(F.col("start"), F.col("end")))
    rows = rows.select("video_id", F.format_string("%s_q%02d", "video_id", F.col("pos") + 1).alias("query_id"), "q.query_type", "q.query_text", "start", "end")
    placed = intervals.resolved(rows.select("video_id", "query_id", "start", "end"), segments, "video_id", "query_id", keep_unmatched=False)
    return rows.join(placed.select("video_id", "query_id", "segment_ids"), ["video_id", "query_id"])


def reground(queries: DataFrame, chosen: DataFrame, segments: DataFrame, allowed: DataFrame) -> DataFrame:
    """Queries with a new choice of segments where it stands, else their own; the old
    ids are kept as ``gen_segment_ids``."""
    index = F.map_from_entries(F.collect_list(F.struct("segment_id", "index")))
    known = segments.groupBy("video_id").agg(index.alias("known"))
    rows = queries.join(chosen.select("video_id", "query_id", F.col("segment_ids").alias("new_ids")), ["video_id", "query_id"], "left").join(allowed, ["video_id", "query_id"], "left").join(known, "video_id", "left")
    places = F.transform("new_ids", lambda s: F.col("known")[s])
    valid = F.coalesce(intervals.valid_selection(F.col("new_ids"), places, F.col("candidates")), F.lit(False))
    out = rows.withColumn("valid", valid).withColumn("gen_segment_ids", F.col("segment_ids")).withColumn("segment_ids", F.when(F.col("valid"), F.col("new_ids")).otherwise(F.col("segment_ids")))
    return out.drop("new_ids", "candidates", "known")


DIMENSIONS = ("emotion_relevance_pass", "answerability_pass", "query_quality_pass")


def verify(pending: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """(video_id, query_id, text) -> verdicts, one call a dimension; a failed call or a
    missing literal fails that dimension alone. Every query gets a verdict."""
    work = pending.select("video_id", "query_id", "text", F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dim"))
    work = work.withColumns({"key": F.concat_ws("\t", "video_id", "query_id", "dim"), "prompt": F.concat_ws("\n", F.lit("verify"), "dim", "text"), "media": F.array().cast("array<string>")})
    v = F.from_json(json_text.first_object(F.col("raw")), "pass boolean, reason string, suggested_revision string")
    said = settled(model_stage(work, client).select("key", v.alias("v"), "error"))
    got = work.select("key", "video_id", "query_id", "dim").join(said, "key", "left").withColumn("ok", F.coalesce(F.col("v.pass"), F.lit(False)))
    got = got.withColumn("reason", F.when(F.col("error").isNotNull(), "call failed").when(F.col("v.pass").isNull(), "invalid format").otherwise(F.col("v.reason")))
    each = got.groupBy("video_id", "query_id").agg(*[F.bool_or((F.col("dim") == d) & F.col("ok")).alias(d) for d in DIMENSIONS], F.concat_ws("; ", F.sort_array(F.collect_list(F.when(~F.col("ok"), F.concat_ws(": ", "dim", "reason"))))).alias("failure_reason"), F.max("v.suggested_revision").alias("suggested_revision"))
    return each.withColumn("decision", json_text.decision(*map(F.col, DIMENSIONS)))


def verify_loop(queries: DataFrame, client: Callable[[], Client], max_rewrites: int = 2, max_accepted: int = 8) -> DataFrame:
    """Traces after at most ``max_rewrites`` + 1 rounds. Pass: accepted. Revise with a
    suggestion and rewrites left: the suggestion is verified next round. Anything else:
    discarded. Then each video keeps its first ``max_accepted`` by id."""
    rounds = F.array().cast("array<struct<round_index:int,decision:string,failure_reason:string>>")
    open_ = queries.select("video_id", "query_id", "query_type", F.col("query_text").alias("initial_text"), F.col("query_text").alias("text"), F.lit(0).alias("rewrite_count"), rounds.alias("rounds"))
    closed = None
    for k in range(1, max_rewrites + 2):  # a round sees and writes the open queries only
        verdicts = verify(open_, client).select("video_id", "query_id", "decision", "failure_reason", F.trim(F.coalesce("suggested_revision", F.lit(""))).alias("suggestion"))
        rows = open_.join(verdicts, ["video_id", "query_id"], "left")
        judged = F.col("decision").isNotNull()
        again = judged & (F.col("decision") == "revise") & (F.length("suggestion") > 0) & (F.col("rewrite_count") < max_rewrites)
        state = settled(
            rows.select(
                "video_id",
                "query_id",
                "query_type",
                "initial_text",
                F.when(again, F.col("suggestion")).otherwise(F.col("text")).alias("text"),
                (F.col("rewrite_count") + F.when(again, 1).otherwise(0)).alias("rewrite_count"),
                F.when(F.col("decision") == "pass", "accepted").when(~judged | again, "pending").otherwise("discarded").alias("final_status"),
                F.when(judged, F.concat("rounds", F.array(F.struct(F.lit(k).alias("round_index"), "decision", "failure_reason")))).otherwise(F.col("rounds")).alias("rounds"),
            )
        )
        done = state.where("final_status <> 'pending'")
        closed = done if closed is None else closed.unionByName(done)
        open_ = state.where("final_status = 'pending'").drop("final_status")
        if k <= max_rewrites and open_.isEmpty():
            break
    columns = ["video_id", "query_id", "query_type", "initial_text", "text", "rewrite_count", "final_status", "rounds"]
    left = open_.withColumn("final_status", F.lit("discarded"))
    return ranking.capped(closed.unionByName(left).select(columns), "video_id", ["query_id"], max_accepted)


def refined(queries: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, query_text) and (key, raw): the rewritten text where the reply supports
    the query, with the guardrail's word check; unsupported queries are flagged."""
    r = F.from_json(json_text.outer_slice(text.without_reasoning(F.col("raw"))), "supported boolean, query string, observed string")
    rows = queries.join(replies.withColumnRenamed("key", "query_id"), "query_id", "left").withColumn("r", r)
    new = F.coalesce(F.col("r.query"), F.col("query_text"))
    rows = rows.withColumn("_dropped", ~F.coalesce(F.col("r.supported"), F.lit(True))).withColumn("_orig", F.col("query_text"))
    back = text.guardrail_reverts(F.col("_orig"), new)
    return rows.withColumn("_reverted", back).withColumn("query_text", F.when(back, F.col("_orig")).otherwise(new)).drop("r", "raw", "error", "attempts")


def match_items(prompts: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs the items of a reply (group, pos, claimed_id) with the segments asked for
    (group, slot, segment_id): by claimed id, the first item of an id winning, then the
    items left over by position, where that segment is still free."""
    known = items.join(prompts, (items["group"] == prompts["group"]) & (items["claimed_id"] == prompts["segment_id"])).select(items["group"], "pos", "slot")
    by_id = known.groupBy("group", "slot").agg(F.min("pos").alias("pos"))
    left = items.join(by_id, ["group", "pos"], "left_anti").select("group", "pos", F.col("pos").alias("slot"))
    by_place = left.join(by_id.select("group", "slot"), ["group", "slot"], "left_anti").join(prompts.select("group", "slot"), ["group", "slot"])
    return by_id.select("group", "slot", "pos").unionByName(by_place.select("group", "slot", "pos"))


WINDOW_PROMPT = "In this {length} s clip, when does it happen: {query}"


def window_scan(queries: DataFrame, client: Callable[[], Client], window: float = 30.0, stride: float = 15.0) -> DataFrame:
    """(query_id, query_text, duration, clip_path) -> (query_id, start, end, support,
    n_windows, n_present): each window is asked by itself, spans are set back on the
    video and clamped, and the best cluster of them is the answer (null without any)."""
    cut = queries.select("query_id", "query_text", "duration", "clip_path", F.posexplode(spans.scan_windows(F.col("duration"), window, stride)).alias("i", "w"))
    prompt = text.rendered(WINDOW_PROMPT, length=F.col("w.length"), query=F.col("query_text"))
    cut = cut.withColumns({"key": F.concat_ws("\t", "query_id", "i"), "prompt": prompt, "media": F.array_compact(F.array("clip_path"))})
    said = cut.select("key", "query_id", "duration", "w").join(settled(model_stage(cut, client)), "key")
    found = F.when(~text.not_present(F.col("raw")), text.time_span(F.col("raw")))
    on_video = lambda r: F.struct(*[spans.clamp(F.col("w.start") + r[i], F.col("duration")).alias(n) for i, n in enumerate(("start", "end"))])
    said = settled(said.select("query_id", text.once(found, on_video).alias("s")).select("query_id", "s.*"))
    good = spans.valid_span(F.col("start"), F.col("end"))
    counts = said.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(good).alias("n_present"))
    best = intervals.cluster_vote(said.where(good), "query_id")
    rows = queries.select("query_id").join(counts, "query_id", "left").join(best, "query_id", "left")
    return rows.select("query_id", "start", "end", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("support", "n_windows", "n_present")])


def with_placeholders(captions: DataFrame, segments: DataFrame) -> DataFrame:
    """A caption for each segment: the first by ``pos``, or a neutral one."""
    first = ranking.first_wins(captions, ["video_id", "segment_id"], "pos")
    rows = segments.select("video_id", "segment_id").join(first, ["video_id", "segment_id"], "left")
    # A caption that says nothing.
    neutral = {"person": "not described", "action": "not described", "sound": "no audible cue", "emotion": "neutral"}
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in neutral.items() if c in captions.columns})
