"""Judging, combined verification and rewriting: stages that never raise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, verdicts
from ..sources.model import Client, model_stage
from . import ranking
from .evals import NO_VERDICT
from .stages import settled

CAPTION_PROMPT = "judge caption {video_id} {segment_id} {time_range}\nVisual: {visual_description}\nAudio: {audio_description}"
EVENT_PROMPT = "judge event {video_id} {event_id} {time_range} {emotion_label}\n{event_description}\n{visual_evidence}\n{audio_evidence}"


def _prompt(rows: DataFrame, template: str, names: list[str]):
    values = {n: (F.to_json(F.coalesce(n, F.array())) if dict(rows.dtypes)[n].startswith("array") else F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names}
    return text.rendered(template, **values)


def _judged(rows: DataFrame, key: list[str], client: Callable[[], Client], verdict, dims: list[str], lost: str) -> DataFrame:
    """Rows with ``prompt`` and ``media`` -> (key, a struct a dimension, parse_error). A row
    without media is never asked for, and a failed call is the row's own error."""
    rows = rows.withColumn("key", F.concat_ws("\t", *key))
    replies = settled(model_stage(rows.where(F.size("media") > 0), client))
    got = rows.join(replies, "key", "left").withColumn("v", verdict)
    named = F.concat(F.lit(lost), F.col(key[-1]).cast("string"))
    # Fixed value: how a failed call is reported.
    problem = F.when(F.size("media") == 0, named).when(F.col("error").isNotNull(), F.concat(F.lit("judge call failed: "), "error")).otherwise(F.col("v.parse_error"))
    heard = (F.size("media") > 0) & F.col("error").isNull()
    return got.select(*key, *[F.when(heard, F.col(f"v.{d}")).alias(d) for d in dims], problem.alias("parse_error"))


def judge_captions(captions: DataFrame, clips: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """A verdict for each caption; ``clips`` is (video_id, segment_id, clip_path)."""
    # Fixed value: what is said of a caption without a clip.
    rows = captions.join(clips, ["video_id", "segment_id"], "left")
    names = ["video_id", "segment_id", "time_range", "visual_description", "audio_description"]
    rows = rows.withColumns({"prompt": _prompt(rows, CAPTION_PROMPT, names), "media": F.array_compact(F.array("clip_path"))})
    return _judged(rows, ["video_id", "segment_id"], client, verdicts.caption_verdict(F.col("raw")), list(verdicts.CAPTION_DIMENSIONS), "no clip found for segment ")


def judge_events(events: DataFrame, clips: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """A verdict for each event; ``clips`` is (video_id, event_id, clip_paths)."""
    # Fixed value: what is said of an event without clips.
    rows = events.join(clips, ["video_id", "event_id"], "left")
    names = ["video_id", "event_id", "time_range", "emotion_label", "event_description", "visual_evidence", "audio_evidence"]
    rows = rows.withColumns({"prompt": _prompt(rows, EVENT_PROMPT, names), "media": F.array_compact(F.coalesce("clip_paths", F.array().cast("array<string>")))})
    return _judged(rows, ["video_id", "event_id"], client, verdicts.event_verdict(F.col("raw"), F.col("emotion_label")), [*verdicts.EVENT_DIMENSIONS, "label_agreement"], "no clip(s) found for event ")


def judge_summary(judged: DataFrame, dims: list[str], *by: str) -> DataFrame:
    """(by, dim, mean, n, n_items, n_errors): means over the scores there are, beside the
    number of verdicts and of those with a problem."""
    totals = [F.count(F.lit(1)).alias("n_items"), F.count_if(F.coalesce(F.length("parse_error") > 0, F.lit(False))).alias("n_errors")]
    scores = [F.struct(F.lit(d).alias("dim"), F.round(F.avg(f"{d}.score"), 6).alias("mean"), F.count(f"{d}.score").alias("n")).alias(d) for d in dims]
    one = judged.groupBy(*by).agg(*totals, *scores)
    return one.select(*by, F.inline(F.array(*dims)), "n_items", "n_errors")


def verify_batched(pending: DataFrame, client: Callable[[], Client], round_index: int = 1, size: int = 4) -> DataFrame:
    """(video_id, query_id, text) -> a verdict each.  Up to ``size`` queries of a video
    share a prompt; a prompt that fails or cannot be read is asked again query by query,
    where the reply's id does not matter; a query without a result fails."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("query_id")) - 1
    asked = pending.select("video_id", "query_id", "text").withColumn("part", F.floor(place / size).cast("int"))
    told = F.to_json(F.sort_array(F.collect_list(F.struct("query_id", "text"))))
    media = F.array().cast("array<string>")
    work = asked.groupBy("video_id", "part").agg(told.alias("told"), F.count(F.lit(1)).alias("n"), F.min("query_id").alias("only"))
    work = work.withColumns({"key": F.concat_ws("\t", "video_id", "part"), "prompt": F.concat(F.lit("verify batch\n"), "told"), "media": media})
    read = verdicts.verification_results(F.col("raw"), F.col("video_id").cast("string"), F.lit(round_index))
    got = settled(work.join(model_stage(work, client), "key").withColumn("results", read).select("video_id", "part", "n", "only", "results"))
    single = asked.join(got.where("results is null").select("video_id", "part"), ["video_id", "part"], "left_semi")
    single = single.withColumns({"key": F.concat_ws("\t", "video_id", "query_id"), "prompt": F.concat(F.lit("verify one\n"), F.to_json(F.struct("query_id", "text"))), "media": media})
    again = single.join(settled(model_stage(single, client)), "key").select("video_id", "query_id", F.try_element_at(read, F.lit(1)).alias("r"))
    pinned = lambda own: F.when(F.col("n") == 1, F.col("only").cast("string")).otherwise(own)
    first = got.select("video_id", "n", "only", F.posexplode("results").alias("pos", "r")).select("video_id", pinned(F.col("r.query_id")).alias("q"), "pos", "r")
    every = first.unionByName(again.where("r is not null").select("video_id", F.col("query_id").cast("string").alias("q"), F.lit(0).alias("pos"), "r"))
    one = ranking.first_wins(every, ["video_id", "q"], "pos").select("video_id", "q", "r")
    rows = asked.withColumn("q", F.col("query_id").cast("string")).join(one, ["video_id", "q"], "left")
    passes = [F.coalesce(f"r.{n}", F.lit(False)).alias(n) for n in ("emotion_relevance_pass", "answerability_pass", "query_quality_pass")]
    return rows.select("video_id", "query_id", F.lit(round_index).alias("round_index"), *passes, F.coalesce("r.failure_reason", F.lit(NO_VERDICT)).alias("failure_reason"), F.coalesce("r.suggested_revision", F.lit("")).alias("suggested_revision"), F.coalesce("r.decision", F.lit("fail")).alias("decision"))


def rewrite_stage(rejected: DataFrame, client: Callable[[], Client], round_index: int = 1) -> DataFrame:
    """(video_id, query_id, text, failure_reason) -> rewrites, one call a video; rewrites of
    queries that were not asked about go."""
    told = F.to_json(F.sort_array(F.collect_list(F.struct("query_id", "text", "failure_reason"))))
    work = rejected.groupBy("video_id").agg(told.alias("told")).withColumns({"key": F.col("video_id").cast("string"), "prompt": F.concat(F.lit("rewrite\n"), "told"), "media": F.array().cast("array<string>")})
    read = verdicts.rewrites(F.col("raw"), F.col("video_id").cast("string"), F.lit(round_index))
    rows = work.join(settled(model_stage(work, client)), "key").select(F.col("video_id").alias("_v"), F.inline(read))
    rows = rows.drop("video_id").withColumnRenamed("_v", "video_id")
    return rows.join(rejected.select("video_id", F.col("query_id").cast("string").alias("query_id")), ["video_id", "query_id"], "left_semi")


def readable(reply: str) -> bool:
    """Whether a reply holds JSON: ``model_stage(accept=readable)`` draws again if not."""
    import json

    cut = reply[min((i for i in (reply.find("{"), reply.find("[")) if i >= 0), default=len(reply)) :]
    try:
        json.JSONDecoder().raw_decode(cut)
    except ValueError:
        return False
    return True


def placed_queries(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Queries (video_id, event_id, pos, query_type, query_text) with the span, segments
    and description of their event, numbered through each video."""
    rows = asked.join(events.select("video_id", "event_id", "time_range", "segment_ids", F.col("event_description").alias("grounding_event_description"), "target_person_or_group"), ["video_id", "event_id"])
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("event_id", "pos"))
    return rows.withColumn("query_id", F.format_string("%s_mm%03d", F.col("video_id").cast("string"), number)).drop("pos")


def captions_of(queries: DataFrame, captions: DataFrame) -> DataFrame:
    """(video_id, query_id, source_caption_ids): captions whose segments meet the
    query's, in their order; by a join on the segment, so any number of captions."""
    c = captions.select("video_id", "caption_id", "pos", F.explode("segment_ids").alias("segment_id"))
    q = queries.select("video_id", "query_id", F.explode("segment_ids").alias("segment_id"))
    met = q.join(c, ["video_id", "segment_id"]).groupBy("video_id", "query_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "caption_id"))), lambda x: x["caption_id"]).alias("source_caption_ids"))
    return queries.join(met, ["video_id", "query_id"], "left").withColumn("source_caption_ids", F.coalesce("source_caption_ids", F.array().cast("array<string>")))


def captions_by_segment(captions: DataFrame, segments: DataFrame, order: str) -> DataFrame:
    """(video_id, segment_id, time_range, caption): the last caption of each known segment
    with the segment's own span, to two decimals."""
    last = ranking.last_wins(captions, ["video_id", "segment_id"], order)
    span = F.array(F.round("start_time", 2), F.round("end_time", 2))
    body = text.payload(F.col("visual_description"), F.col("audio_description"))
    return segments.select("video_id", "segment_id", span.alias("time_range")).join(last.select("video_id", "segment_id", body.alias("caption")), ["video_id", "segment_id"])


def with_verdicts(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """Verdicts with the text, type and span of their query."""
    return judged.join(queries.select("video_id", "query_id", "query_text", "query_type", "time_range"), ["video_id", "query_id"], "left")


def with_clip(rows: DataFrame, clips: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have a clip, with it, and those without."""
    both = rows.join(clips.select(*key, "clip_path"), key, "left")
    return both.where("clip_path is not null"), both.where("clip_path is null").drop("clip_path")


def raw_record(rows: DataFrame) -> DataFrame:
    """Raw replies by modality: one for av, audio and video apart for a pair."""
    joint = F.col("modality") != "audio+video"
    return rows.select("video_id", "segment_id", "modality", F.when(joint, F.col("raw")).alias("raw"), F.when(~joint, F.col("raw_audio")).alias("raw_audio"), F.when(~joint, F.col("raw_video")).alias("raw_video"))


def without_bookkeeping(rows: DataFrame) -> DataFrame:
    """Rows less the columns that refining left behind."""
    return rows.drop("_orig", "_dropped", "_reverted")
