"""Human annotations as inputs of an evaluation: gold rows, queries and segments.

Annotations: (video_id, query_id, pos, query_type, final_query_text,
initial_query_text, segment_ids, approximate_time, human_emotion_relevant,
human_answerability, human_query_quality); ``pos`` is the place in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text, spans, text
from ..sources import records

_JUDGED = ("human_emotion_relevant", "human_answerability", "human_query_quality")
_GOLD = ("gold_emotion_relevant", "gold_answerability", "gold_query_quality")


def _full(c: str) -> Column:
    return F.when(F.length(c) > 0, F.col(c))


def query_text() -> Column:
    return F.coalesce(_full("final_query_text"), _full("initial_query_text"), F.lit(""))


def gold(annotations: DataFrame) -> DataFrame:
    """Three labels and the decision that follows from them; all are null unless each
    label is 'pass' or 'fail'."""
    whole = reduce(Column.__and__, [F.coalesce(F.col(c).isin("pass", "fail"), F.lit(False)) for c in _JUDGED])
    rows = annotations.select("video_id", "query_id", query_text().alias("query_text"), "segment_ids", *[F.when(whole, F.col(c) == "pass").alias(g) for c, g in zip(_JUDGED, _GOLD, strict=True)])
    return rows.withColumn("gold_decision", F.when(F.col(_GOLD[0]).isNotNull(), json_text.decision(*map(F.col, _GOLD))))


def annotated_queries(annotations: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Queries with the range their time text names, else the hull of their segments on
    the grid, else null."""
    on_grid = F.transform("segment_ids", lambda s: spans.grid_span(s, seconds))
    hull = F.when(F.size("segment_ids") > 0, F.array(F.array_min(F.transform(on_grid, lambda g: g["start"])), F.array_max(F.transform(on_grid, lambda g: g["end"]))))
    kind = F.coalesce(_full("query_type"), F.lit("emotion_state"))
    return annotations.select("video_id", "query_id", kind.alias("query_type"), query_text().alias("query_text"), F.coalesce(text.range_in_text(F.col("approximate_time")), hull).alias("time_range"), "segment_ids")


def annotated_segments(annotations: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Each cited segment once. Its bounds are those that the last query citing it alone
    names in its time text, else the grid's. One aggregation, no self-join."""
    cited = annotations.select("video_id", "pos", F.size("segment_ids").alias("n"), text.range_in_text(F.col("approximate_time")).alias("r"), F.explode("segment_ids").alias("segment_id"))
    named = F.when((F.col("n") == 1) & F.col("r").isNotNull(), F.col("pos"))
    rows = cited.groupBy("video_id", "segment_id").agg(F.max_by("r", named).alias("r")).withColumn("g", spans.grid_span(F.col("segment_id"), seconds))
    return rows.select("video_id", "segment_id", F.col("g.index").alias("index"), F.coalesce(F.col("r")[0], F.col("g.start")).alias("start_time"), F.coalesce(F.col("r")[1], F.col("g.end")).alias("end_time"), F.lit(None).cast("string").alias("clip_path"))


def write_eval_inputs(annotations: DataFrame, folder: str, seconds: float = 5.0) -> None:
    """gold, initial_queries (nested by video) and segments as JSON lines."""
    queries = annotated_queries(annotations, seconds)
    records.export_run({"gold": gold(annotations), "initial_queries": records.nested_by_video(queries, queries), "segments": annotated_segments(annotations, seconds)}, folder)
