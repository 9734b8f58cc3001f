"""Events set on the segments that their evidence cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text


def confident() -> Column:
    """Neither low confidence nor weak evidence; a null is neither."""
    return (F.coalesce(F.lower("confidence"), F.lit("")) != "low") & (F.coalesce(F.lower("evidence_strength"), F.lit("")) != "weak")


def set_on_citations(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Events (video_id, pos, event_id, time_range, visual_evidence, audio_evidence,
    confidence, evidence_strength, target_person, target_person_or_group, ...) on
    segments (video_id, segment_id, start_time, end_time).

    Cues may open with ``[s012]``.  An event covers every segment from its first to its
    last cited one, so no cue lies outside it; without a known citation it covers what
    its own range overlaps.  Uncertain events, and those that cover nothing, go.
    ``range_fixed`` tells whether citations changed the range.  One join by video: its
    segments come as one sorted array, all else is arithmetic within the row.
    """
    index = spans.grid_span(F.col("segment_id"))["index"]
    grid = segments.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(index.alias("index"), "segment_id", "start_time", "end_time"))).alias("__grid"))
    cues = F.concat(F.coalesce("visual_evidence", F.array()), F.coalesce("audio_evidence", F.array()))
    rows = events.where(confident()).withColumn("__cited", F.transform(cues, text.cited_segment)).join(grid, "video_id")
    hit = F.transform(F.filter("__grid", lambda g: F.array_contains("__cited", g["segment_id"])), lambda g: g["index"])
    rows = rows.withColumns({"__lo": F.array_min(hit), "__hi": F.array_max(hit)})
    between = F.filter("__grid", lambda g: g["index"].between(F.col("__lo"), F.col("__hi")))
    touched = F.filter("__grid", lambda g: (g["start_time"] < F.col("time_range")[1]) & (F.col("time_range")[0] < g["end_time"]))
    rows = rows.withColumn("__on", F.when(F.col("__lo").isNotNull(), between).when(F.size("time_range") == 2, touched)).where(F.size("__on") > 0)
    cover = F.array(F.array_min("__on.start_time"), F.array_max("__on.end_time"))
    new = F.when(F.col("__lo").isNotNull(), cover).otherwise(F.array(F.col("__on")[0]["start_time"], F.element_at("__on", -1)["end_time"]))
    rows = rows.withColumn("__range", new)
    out = {
        "range_fixed": F.col("__lo").isNotNull() & ~F.col("time_range").eqNullSafe(F.col("__range")),
        "time_range": F.col("__range"),
        "segment_ids": F.col("__on.segment_id"),
        "event_id": F.coalesce(F.when(F.length("event_id") > 0, F.col("event_id")), F.concat(F.lit("e"), "pos")),
        "target_person_or_group": F.coalesce(F.when(F.length("target_person") > 0, F.col("target_person")), "target_person_or_group", F.lit("")),
    }
    return rows.withColumns(out).drop("__grid", "__cited", "__lo", "__hi", "__on", "__range")


def citation_counts(events: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: events in, dropped as uncertain, ranges fixed, kept."""
    before = events.agg(F.count(F.lit(1)).alias("in"), F.count_if(~confident()).alias("dropped_lowconf"))
    return before.crossJoin(kept.agg(F.count_if("range_fixed").alias("range_fixed"), F.count(F.lit(1)).alias("kept")))
