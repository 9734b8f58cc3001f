"""Stages that ask a model in batches: captions of several clips, one dimension of
several queries, a video's spans anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_text, payload, schema, spans, text
from ..sources.model import Client, ManyClient, batched_stage, model_stage
from . import intervals, ranking, stages


def reply_items(raw: Column) -> Column:
    """array<variant> of a reply: its first JSON value if that is an array, or one object
    as an array of one; null if nothing can be read."""
    parse = lambda c: F.try_parse_json(F.get_json_object(c, "$"))
    many, one = parse(json_text.first_array(raw)), parse(json_text.first_object(raw))
    listed = F.try_variant_get(many, "$", "array<variant>")
    return F.coalesce(listed, F.when(json_text.first_array(raw).isNull() & one.isNotNull(), F.array(one)))


def caption_batches(segments: DataFrame, done: DataFrame | None, client: Callable[[], ManyClient], template: str, per_prompt: int = 1, per_call: int = 1) -> DataFrame:
    """A caption for each segment that ``done`` lacks: (video_id, segment_id, time_range,
    visual_description, audio_description, confidence, evidence_strength, status, reason).

    ``per_prompt`` clips share a prompt and ``per_call`` prompts a call; a call that fails
    is halved. Items of a reply belong to the segment they name, else to the one at their
    place. ``status``: valid (strict, may be cached), salvaged (what could be read, low
    confidence and weak evidence), failed (the prompt got no reply: to be asked again;
    ``reason`` is the error)."""
    work = segments if done is None else ranking.pending(segments, done, ["video_id", "segment_id"])
    prompts = payload.caption_prompts(work, template, per_prompt)
    prompts = prompts.withColumn("key", F.concat_ws("\t", "video_id", "batch_index"))
    replies = stages.settled(batched_stage(prompts, client, per_call))
    got = prompts.select("key", "video_id", "segment_ids").join(replies, "key")
    asked = got.select(F.col("key").alias("group"), "video_id", F.posexplode("segment_ids").alias("slot", "segment_id"), "raw", "error")
    said = got.select(F.col("key").alias("group"), F.posexplode(reply_items(F.col("raw"))).alias("pos", "item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    said = said.withColumn("claimed_id", F.try_variant_get("item", "$.segment_id", "string"))
    said = said.select("group", "pos", "claimed_id", F.to_json("item").alias("body"))
    pairs = stages.match_items(asked.select("group", "slot", "segment_id"), said.select("group", "pos", "claimed_id"))
    rows = asked.join(pairs.join(said.select("group", "pos", "body"), ["group", "pos"]).select("group", "slot", "body"), ["group", "slot"], "left")
    rows = rows.join(segments.select("video_id", "segment_id", "start_time", "end_time"), ["video_id", "segment_id"])
    strict = schema.strict_caption(F.col("body"), F.col("video_id"), F.col("segment_id"), F.col("start_time"), F.col("end_time"))
    salvaged = json_text.normalized_caption(F.coalesce("body", "raw"), F.lit("av"), F.lit("low"))
    rows = rows.withColumn("c", strict).withColumn("s", salvaged)
    good, lost = F.col("c.caption").isNotNull(), F.col("error").isNotNull()
    pick = lambda name, weak: F.when(good, F.col(f"c.caption.{name}")).when(~lost, weak).alias(name)
    return rows.select(
        "video_id",
        "segment_id",
        F.array(F.round("start_time", 2), F.round("end_time", 2)).alias("time_range"),
        pick("visual_description", F.col("s.visual_description")),
        pick("audio_description", F.col("s.audio_description")),
        pick("confidence", F.lit("low")),
        pick("evidence_strength", F.lit("weak")),
        F.when(good, "valid").when(lost, "failed").otherwise("salvaged").alias("status"),
        F.when(lost, F.col("error")).when(~good, F.col("c.reason")).alias("reason"),
    )


_GROUP = pa.schema([("key", pa.string()), ("raws", pa.list_(pa.string())), ("error", pa.string())])


def grouped_stage(work: DataFrame, client: Callable[[], ManyClient]) -> DataFrame:
    """(key, prompts array<string>, media array<array<string>>) -> (key, raws, error): each
    row's prompts are one call, which answers all of them or fails as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.select(["key", "prompts", "media"]).to_pylist():
                try:
                    raws = own.ask_many([(p, m or []) for p, m in zip(row["prompts"], row["media"], strict=True)])
                    if len(raws) != len(row["prompts"]):
                        raise ValueError(f"{len(raws)} replies to {len(row['prompts'])} prompts")
                    out.append((row["key"], list(raws), None))
                except Exception as problem:  # any failure of a client is its group's own
                    out.append((row["key"], None, f"{type(problem).__name__}: {problem}"))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_GROUP)], schema=_GROUP)

    return work.select("key", "prompts", "media").mapInArrow(run, "key string, raws array<string>, error string")


# The judged dimensions, in their order, and whether one watches the clip.
WATCHES = {"emotion_relevance_pass": False, "answerability_pass": True, "query_quality_pass": False}


def verify_by_dimension(queries: DataFrame, client: Callable[[], ManyClient], templates: dict[str, str], round_index: int = 1, size: int = 1) -> DataFrame:
    """(video_id, query_id, query_text, media array<string>) -> a verdict each.

    Each dimension is asked by itself, ``size`` queries of a video to a call, so a call is
    all text or all clips. Queries go in order of ``pos`` if they have one, else of their
    ids; one verdict is told for each id. A call that fails fails its queries in that dimension alone
    ("call failed"); a reply without the literal fails with "invalid format"."""
    pos = F.col("pos" if "pos" in queries.columns else "query_id")
    place = F.floor((F.row_number().over(Window.partitionBy("video_id").orderBy(pos)) - 1) / size).cast("int")
    parts = queries.select("video_id", "query_id", "query_text", "media", pos.alias("pos"), place.alias("part"))
    one = parts.select("*", F.array(F.struct("query_id", "query_text")).alias("_one"))
    shown = payload.pretty_column(one, "_one")
    rows = None
    for k, dim in enumerate(WATCHES):
        prompt = text.rendered(templates[dim], video_id=F.col("video_id"), round_index=F.lit(round_index), queries_json=shown)
        own = one.select("video_id", "part", "pos", "query_id", F.lit(k).alias("k"), F.lit(dim).alias("dim"), prompt.alias("prompt"), (F.coalesce("media", F.array().cast("array<string>")) if WATCHES[dim] else F.array().cast("array<string>")).alias("media"))
        rows = own if rows is None else rows.unionByName(own)
    packed = F.sort_array(F.collect_list(F.struct("pos", "query_id", "prompt", "media")))
    work = rows.groupBy("video_id", "part", "k", "dim").agg(packed.alias("p"))
    work = work.select(F.concat_ws("\t", "video_id", "part", "dim").alias("key"), "video_id", "k", "dim", F.col("p.query_id").alias("ids"), F.col("p.pos").alias("places"), F.col("p.prompt").alias("prompts"), F.col("p.media").alias("media"))
    got = work.select("key", "video_id", "k", "dim", "ids", "places").join(stages.settled(grouped_stage(work, client)), "key")
    each = got.select("video_id", "k", "dim", "error", F.posexplode("ids").alias("at", "query_id"), "raws", "places").withColumn("raw", F.get("raws", F.col("at"))).withColumn("pos", F.get("places", F.col("at")))
    value = F.coalesce(*[F.when(F.col("dim") == d, json_text.verdict(F.col("raw"), d)) for d in WATCHES])
    each = each.withColumn("v", value).withColumn("ok", F.col("error").isNull() & F.coalesce(F.col("v.pass"), F.lit(False)))
    why = F.when(F.col("error").isNotNull(), "call failed").otherwise(F.col("v.reason"))
    told = F.when(~F.col("ok") & (F.length(why) > 0), F.struct("k", "pos", F.concat_ws(": ", F.regexp_replace("dim", "_pass$", ""), why).alias("t")))
    g = each.groupBy("video_id", "query_id").agg(*[F.bool_or((F.col("dim") == d) & F.col("ok")).alias(d) for d in WATCHES], F.array_join(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["t"]), "; ").alias("failure_reason"))
    return g.select("video_id", "query_id", F.lit(round_index).alias("round_index"), json_text.decision(*map(F.col, WATCHES)).alias("decision"), *WATCHES, "failure_reason", F.lit("").alias("suggested_revision"))


GROUNDINGS = "groundings array<struct<query_id:string,segment_ids:array<string>>>"


def reground_stage(queries: DataFrame, captions: DataFrame, segments: DataFrame, client: Callable[[], Client], template: str, window: int | None = None) -> DataFrame:
    """Queries (video_id, query_id, query_text, time_range, segment_ids) with their segments
    chosen anew by one call a video; ``gen_time_range`` and ``gen_segment_ids`` keep the old
    ones. ``window``: only segments within so many places of the old ones may be chosen.

    A choice stands if it is not empty, known, without repeats and without holes; else, and
    for all queries of a video whose call fails or cannot be read, the old one stays
    (``outcome``: changed, same or fallback). Queries that stand get the span of their
    segments and the captions that show them (``source_caption_ids``)."""
    band = intervals.candidate_band(queries, segments, "video_id", window if window is not None else 1 << 30)
    work = payload.regrounding_prompts(queries, captions, segments, band, template)
    work = work.withColumns({"key": F.col("video_id"), "media": F.array().cast("array<string>")})
    replies = stages.settled(model_stage(work, client))
    read = F.from_json(json_text.first_object(F.col("raw")), GROUNDINGS)["groundings"]
    chosen = replies.where("error IS NULL").select(F.col("key").alias("video_id"), F.posexplode(read).alias("pos", "g")).select("video_id", "pos", "g.query_id", F.col("g.segment_ids").alias("segment_ids"))
    chosen = ranking.last_wins(chosen, ["video_id", "query_id"], "pos").select("video_id", "query_id", F.col("segment_ids").alias("new"))
    places = segments.select("video_id", "segment_id", "index", "start_time", "end_time")
    each = chosen.select("video_id", "query_id", F.explode("new").alias("segment_id")).join(places, ["video_id", "segment_id"], "left")
    if window is not None:
        allowed = band.select("video_id", "query_id", F.explode("candidates").alias("segment_id"), F.lit(True).alias("allowed"))
        each = each.join(allowed, ["video_id", "query_id", "segment_id"], "left")
    else:
        each = each.withColumn("allowed", F.lit(True))
    fine = F.bool_and(F.col("index").isNotNull() & F.coalesce("allowed", F.lit(False))) & (F.count_distinct("segment_id") == F.count(F.lit(1))) & (F.max("index") - F.min("index") + 1 == F.count(F.lit(1)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("index", "segment_id"))), lambda s: s["segment_id"])
    new = each.groupBy("video_id", "query_id").agg(fine.alias("fine"), ordered.alias("ids"), F.array(F.round(F.min("start_time"), 2), F.round(F.max("end_time"), 2)).alias("span")).where("fine").drop("fine")
    rows = queries.join(new, ["video_id", "query_id"], "left")
    stands = F.col("ids").isNotNull()
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "gen_time_range": F.coalesce("time_range", F.array().cast("array<double>")),
        "gen_segment_ids": F.coalesce("segment_ids", none),
        "outcome": F.when(~stands, "fallback").when(F.col("ids") == F.coalesce("segment_ids", none), "same").otherwise("changed"),
    })
    rows = rows.withColumns({"time_range": F.when(stands, F.col("span")).otherwise(F.col("time_range")), "segment_ids": F.when(stands, F.col("ids")).otherwise(F.col("segment_ids"))}).drop("ids", "span")
    seen = payload.observation_rows(captions, segments).select("video_id", "caption_id", "pos", F.explode("segment_ids").alias("segment_id"))
    met = rows.where("outcome <> 'fallback'").select("video_id", "query_id", F.explode("segment_ids").alias("segment_id")).join(seen, ["video_id", "segment_id"])
    ids = F.transform(F.array_sort(F.collect_set(F.struct("pos", "caption_id"))), lambda x: x["caption_id"])
    sources = met.groupBy("video_id", "query_id").agg(ids.alias("_found"))
    out = rows.drop("source_caption_ids").join(sources, ["video_id", "query_id"], "left")
    if "source_caption_ids" in queries.columns:
        out = out.join(queries.select("video_id", "query_id", F.col("source_caption_ids").alias("_old")), ["video_id", "query_id"])
    else:
        out = out.withColumn("_old", none)
    kept = F.when(F.col("outcome") == "fallback", F.col("_old")).otherwise(F.coalesce("_found", none))
    return out.withColumn("source_caption_ids", kept).drop("_found", "_old")


def reground_compared(annotations: DataFrame, regrounded: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row over annotated queries that can be grounded: (query_id, not_groundable,
    human_time_ranges array<array<double>>, model_time_range) against (query_id,
    time_range): mean IoU and hits of the old and of the new span, and of the spans that
    moved how many came closer or went farther by more than ``margin``. A query without a
    new span keeps its old IoU; without human spans it counts as met. Human spans that touch
    are merged first, within the row: rows of spans are never sorted or joined."""
    kept = annotations.where(~F.coalesce("not_groundable", F.lit(False)))
    three = kept.select("query_id", F.col("model_time_range").alias("old"), spans.merged("human_time_ranges").alias("_human"))
    three = three.join(regrounded.select("query_id", F.col("time_range").alias("new")), "query_id", "left")
    alone = lambda c: spans.valid_span(F.col(c)[0], F.col(c)[1]).cast("double")
    best = lambda c: F.max(F.when(F.size("_human") > 0, spans.max_iou(F.col(c), F.col("_human"))).otherwise(alone(c)))
    one = three.groupBy("query_id", "old", "new").agg(best("old").alias("a"), best("new").alias("n")).withColumn("b", F.when(F.col("new").isNull(), F.col("a")).otherwise(F.col("n")))
    moved = F.col("new").isNotNull() & (F.col("new") != F.col("old"))
    a, b = F.col("a"), F.col("b")
    return one.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("miou_old"), F.round(F.avg("b"), 6).alias("miou_new"), F.count_if(a >= 0.5).alias("hit_old"), F.count_if(b >= 0.5).alias("hit_new"), F.count_if(moved).alias("changed"), F.count_if(moved & (b > a + margin)).alias("better"), F.count_if(moved & (a > b + margin)).alias("worse"))


def with_extracted_clips(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Segments with the path of the clip cut for them (clips: video_id, index, clip_path),
    by their index; null where none was cut, whatever path stood there before. Of several
    clips of one index the greatest path counts."""
    one = clips.groupBy("video_id", "index").agg(F.max("clip_path").alias("clip_path"))
    return segments.drop("clip_path").join(one, ["video_id", "index"], "left").select(segments.columns)


def run_warnings(events: DataFrame, queries: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, stage, warning) of videos for which a stage gave nothing."""
    # The warnings of an empty stage.
    said = {
        "events": "emotion-event stage produced 0 events; no emotion to ground queries on (generation will return 0 queries).",
        "queries": "query-generation stage produced 0 queries for these captions.",
    }
    out = None
    for stage, df in (("events", events), ("queries", queries)):
        lost = videos.select("video_id").distinct().join(df.select("video_id"), "video_id", "left_anti").select("video_id", F.lit(stage).alias("stage"), F.lit(said[stage]).alias("warning"))
        out = lost if out is None else out.unionByName(lost)
    return out
