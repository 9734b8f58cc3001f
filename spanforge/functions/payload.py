"""Prompts as column expressions: templates, and payloads as indented JSON.

The JSON is that of a pretty printer with two spaces an indent, as prompts show it: a
member or element a line, ``[]`` and ``{}`` for empty ones, nulls kept, letters beyond
ASCII as they are.  It is built in the JVM from the column's type, so no row leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

_CONTROL = [f"{i:04X}" for i in range(32) if f"{i:04X}" != f"{i:04x}"]


def quoted(x: Column) -> Column:
    """A text as a JSON string."""

    def lowered(out: Column) -> Column:
        small = out
        for code in _CONTROL:  # hexadecimal digits of control characters are small
            small = F.regexp_replace(small, r"(?<!\\)((?:\\\\)*)\\u" + code, r"$1\\u" + code.lower())
        return F.when(out.contains("\\u00"), small).otherwise(out)

    return text.once(F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1"), lowered)


def number(x: Column) -> Column:
    """A double as its shortest text: 5.0, 0.25, 1e-05, 1e+16."""
    plain = x.cast("string")
    size = F.abs(x)
    whole = F.concat(x.cast("decimal(20,0)").cast("string"), F.lit(".0"))
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^([^E]*)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?\d+)$", 1).cast("int")
    small = F.concat(mantissa, F.lit("e-"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    large = F.concat(mantissa, F.lit("e+"), F.lpad(power.cast("string"), 2, "0"))
    tenth = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0.000"), F.regexp_replace(mantissa, r"[-.]", ""))
    named = F.when(F.isnan(x), "NaN").when(size == F.lit(float("inf")), F.when(x > 0, "Infinity").otherwise("-Infinity"))
    return F.coalesce(
        named,
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), plain)
        .when(size >= 1e16, large)
        .when(size >= 1e7, F.when(x == F.floor(x), whole).otherwise(F.regexp_replace(F.format_string("%.9f", x), r"(\.\d+?)0+$", "$1")))
        .when(size >= 1e-4, tenth)
        .otherwise(small),
    )


def _value(x: Column, kind: T.DataType, indent: str) -> Column:
    """The text of a value that is not null."""
    inner = indent + "  "
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return F.lit("{}")
        members = [F.concat(F.lit(f"{inner}{_name(f.name)}: "), pretty(x[f.name], f.dataType, inner)) for f in kind.fields]
        return F.concat(F.lit("{\n"), F.concat_ws(",\n", *members), F.lit(f"\n{indent}}}"))
    if isinstance(kind, T.ArrayType):
        lines = F.transform(x, lambda e: F.concat(F.lit(inner), pretty(e, kind.elementType, inner)))
        return F.when(F.size(x) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(lines, ",\n"), F.lit(f"\n{indent}]")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number(x.cast("double"))
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        return x.cast("string")
    return quoted(x.cast("string"))


def _name(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def pretty(x: Column, kind: T.DataType, indent: str = "") -> Column:
    """A value of type ``kind`` as indented JSON, null as null."""
    return F.when(x.isNull(), "null").otherwise(_value(x, kind, indent))


def pretty_column(rows: DataFrame, name: str) -> Column:
    return pretty(F.col(name), rows.schema[name].dataType)


def listed(x: Column, kind: T.ArrayType) -> Column:
    """An array as a prompt's plain text shows it: [0.0, 5.0], ['a', "it's"]; nulls None."""

    def shown(e: Column) -> Column:
        if isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            return number(e.cast("double"))
        if isinstance(kind.elementType, T.StringType):
            body = F.replace(F.replace(F.replace(F.replace(e, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
            double = e.contains("'") & ~e.contains('"')
            return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        return e.cast("string")

    return F.when(x.isNull(), "None").otherwise(F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: F.coalesce(shown(e), F.lit("None"))), ", "), F.lit("]")))


def _packed(rows: DataFrame, by: list[str], order: list[str], name: str, fields: list[Column]) -> DataFrame:
    """(by, name): the rows of a group in order, as an array of structs of ``fields``."""
    g = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("_f")))).alias("_p"))
    return g.select(*by, F.transform("_p", lambda p: p["_f"]).alias(name))


def observation_rows(captions: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, caption_id, pos, segment_ids, time_range, caption, confidence,
    evidence_strength) of captions of either kind: by segment (segment_id, time_range,
    visual_description, audio_description) or flat (caption_id, segment_ids, person,
    action, sound, observable_evidence). The span is the caption's own if it has two
    ends, else that of its known segments; captions without any span are left out."""
    flat = "segment_ids" in captions.columns
    ids = F.col("segment_ids") if flat else F.array("segment_id")
    name = F.col("caption_id") if flat else F.concat_ws("_", "video_id", "segment_id")
    own = F.col("time_range") if not flat and "time_range" in captions.columns else F.lit(None).cast("array<double>")
    pos = F.col("pos") if "pos" in captions.columns else F.col("segment_id") if not flat else F.col("caption_id")
    full = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    if flat:
        person = full(F.concat_ws(" ", *[F.when(F.length(c) > 0, F.col(c)) for c in ("person", "action")]))
        seen = F.when(F.size("observable_evidence") > 0, F.array_join("observable_evidence", ", "))
        visual, audio = F.concat_ws(" ", person, seen), F.col("sound")
    else:
        prose = F.lit(None).cast("string")
        if "visual_objective" in captions.columns:
            prose = text.visual_prose(F.col("visual_objective.people"), F.col("visual_objective.scene"), F.col("visual_expression"), F.col("temporal_description"))
        visual, audio = F.coalesce(full(F.col("visual_description")), prose, F.lit("")), F.col("audio_description")
    rows = captions.select("video_id", name.alias("caption_id"), pos.alias("pos"), ids.alias("segment_ids"), own.alias("own"), text.payload(visual, F.coalesce(audio, F.lit(""))).alias("caption"), "confidence", "evidence_strength")
    times = segments.select("video_id", F.col("segment_id").alias("_s"), "start_time", "end_time")
    each = rows.select("video_id", "caption_id", F.explode_outer("segment_ids").alias("_s"))
    span = each.join(times, ["video_id", "_s"], "left").groupBy("video_id", "caption_id").agg(F.min("start_time").alias("lo"), F.max("end_time").alias("hi"))
    placed = rows.join(span, ["video_id", "caption_id"], "left").withColumn("time_range", text.caption_span(F.col("own"), F.col("lo"), F.col("hi")))
    return placed.where("time_range IS NOT NULL").select("video_id", "caption_id", "pos", "segment_ids", "time_range", "caption", "confidence", "evidence_strength")


def _json_of(rows: DataFrame, by: list[str], order: list[str], fields: list[Column]) -> DataFrame:
    """(by, json): each group's rows as one indented array."""
    packed = _packed(rows, by, order, "_rows", fields)
    return packed.select(*by, pretty_column(packed, "_rows").alias("json"))


def captions_json(captions: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, json): what a prompt shows of a video's captions."""
    return _json_of(observation_rows(captions, segments), ["video_id"], ["pos", "caption_id"], [F.col(c) for c in ("time_range", "caption", "confidence", "evidence_strength")])


# Fixed value: what a prompt shows of an event, in its order.
EVENT_FIELDS = ("event_id", "emotion_label", "event_description", "time_range", "target_person_or_group", "visual_evidence", "audio_evidence", "confidence", "evidence_strength")


def events_json(events: DataFrame) -> DataFrame:
    """(video_id, json) of the events, without the segments they were placed on; in order
    of ``pos`` if they have one, else of their ids."""
    return _json_of(events, ["video_id"], [*(["pos"] if "pos" in events.columns else []), "event_id"], [F.col(c) for c in EVENT_FIELDS])


def _videos(segments: DataFrame) -> DataFrame:
    return segments.select("video_id").distinct()


def event_prompts(captions: DataFrame, segments: DataFrame, template: str) -> DataFrame:
    """(video_id, prompt): {video_id} and {captions_json}; a video without captions has []."""
    rows = _videos(segments).join(captions_json(captions, segments), "video_id", "left")
    return rows.select("video_id", text.rendered(template, video_id=F.col("video_id"), captions_json=F.coalesce("json", F.lit("[]"))).alias("prompt"))


def generation_prompts(captions: DataFrame, events: DataFrame, segments: DataFrame, template: str) -> DataFrame:
    """(video_id, prompt) of videos that have captions and events: {video_id},
    {captions_json}, {events_json}."""
    c = captions_json(captions, segments).withColumnRenamed("json", "c")
    rows = c.join(events_json(events).withColumnRenamed("json", "e"), "video_id")
    return rows.select("video_id", text.rendered(template, video_id=F.col("video_id"), captions_json=F.col("c"), events_json=F.col("e")).alias("prompt"))


def caption_prompts(segments: DataFrame, template: str, per_prompt: int = 1) -> DataFrame:
    """(video_id, batch_index, segment_ids, prompt): clips of up to ``per_prompt`` segments
    that follow each other by ``index``: {video_id}, {batch_index}, {segment_list}."""
    batch = F.floor((F.col("index") - 1) / per_prompt).cast("int")
    g = segments.groupBy("video_id", batch.alias("batch_index")).agg(F.sort_array(F.collect_list(F.struct("index", "segment_id", "start_time", "end_time", "clip_path"))).alias("s"))
    return g.select(
        "video_id",
        "batch_index",
        F.transform("s", lambda x: x["segment_id"]).alias("segment_ids"),
        F.transform("s", lambda x: F.coalesce(x["clip_path"], F.lit(""))).alias("media"),
        text.rendered(template, video_id=F.col("video_id"), batch_index=F.col("batch_index"), segment_list=text.clip_lines(F.col("s"))).alias("prompt"),
    )


def regrounding_prompts(queries: DataFrame, captions: DataFrame, segments: DataFrame, candidates: DataFrame, template: str) -> DataFrame:
    """(video_id, prompt), one a video: {video_id}, {queries_json}. Each query shows its own
    candidates (``candidates``: video_id, query_id, candidates), as far as they have a
    caption, in segment order."""
    seen = _by_segment(captions, segments)
    each = candidates.select("video_id", "query_id", F.posexplode_outer("candidates").alias("at", "segment_id")).join(seen, ["video_id", "segment_id"], "left")
    told = F.when(F.col("caption").isNotNull(), F.struct("at", F.struct("segment_id", "time_range", "caption").alias("c")))
    packed = each.groupBy("video_id", "query_id").agg(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["c"]).alias("candidate_segments"))
    rows = queries.select("video_id", "query_id", "query_text").join(packed, ["video_id", "query_id"])
    shown = _json_of(rows, ["video_id"], ["query_id"], [F.col(c) for c in ("query_id", "query_text", "candidate_segments")])
    return shown.select("video_id", text.rendered(template, video_id=F.col("video_id"), queries_json=F.col("json")).alias("prompt"))


def _by_segment(captions: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, segment_id, time_range, caption): the segment's own span beside its
    caption, the last by ``pos`` where several name it."""
    rows = observation_rows(captions, segments).select("video_id", "pos", "caption", F.explode("segment_ids").alias("segment_id"))
    last = rows.groupBy("video_id", "segment_id").agg(F.max_by("caption", "pos").alias("caption"))
    span = segments.select("video_id", "segment_id", F.array(F.round("start_time", 2), F.round("end_time", 2)).alias("time_range"))
    return last.join(span, ["video_id", "segment_id"])


def verification_prompts(queries: DataFrame, template: str, round_index: int, *by: str) -> DataFrame:
    """(video_id, [by,] prompt): {video_id}, {round_index}, {queries_json} of all queries of a
    video, or of each group ``by``; the verifier sees id and text only."""
    shown = _json_of(queries, ["video_id", *by], ["query_id"], [F.col("query_id"), F.col("query_text")])
    return shown.select("video_id", *by, text.rendered(template, video_id=F.col("video_id"), round_index=F.lit(round_index), queries_json=F.col("json")).alias("prompt"))


# Fixed value: what a rewrite prompt shows of a query, and of its verdict.
REWRITE_FIELDS = {"query_id": "query_id", "query_type": "query_type", "query_text": "query_text", "grounding_event_description": "grounding_event_description", "approximate_grounding_time": "approximate_grounding_time", "target_person_or_group": "target_person_or_group", "verifier_decision": "decision", "failure_reason": "failure_reason", "suggested_revision": "suggested_revision"}


def rewrite_prompts(failing: DataFrame, template: str, round_index: int) -> DataFrame:
    """(video_id, prompt): {video_id}, {round_index}, {queries_with_feedback_json} of queries
    with their verdicts."""
    shown = _json_of(failing, ["video_id"], ["query_id"], [F.col(c).alias(n) for n, c in REWRITE_FIELDS.items()])
    return shown.select("video_id", text.rendered(template, video_id=F.col("video_id"), round_index=F.lit(round_index), queries_with_feedback_json=F.col("json")).alias("prompt"))


def judge_prompts(rows: DataFrame, template: str, *names: str) -> Column:
    """A judge's prompt: each {name} as text, arrays as their plain list."""
    kinds = {f.name: f.dataType for f in rows.schema}
    values = {n: listed(F.col(n), kinds[n]) if isinstance(kinds[n], T.ArrayType) else F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in names}
    return text.rendered(template, **values)
