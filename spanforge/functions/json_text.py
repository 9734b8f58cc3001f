"""JSON found in noisy model replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains
from .text import enum_or, once, scrubbed, without_reasoning

REQUIRED = ("segment_id", "time_range", "visual_description", "audio_description", "confidence", "evidence_strength")


def _unfenced(x: Column) -> Column:
    body = without_reasoning(x)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(F.length(fenced) > 0, fenced).otherwise(body)


def first_object(x: Column) -> Column:
    """The reply from its first '{'; null without one. Text behind the object is
    ignored by from_json."""
    body = _unfenced(x)
    at = F.locate("{", body)
    return F.when(at > 0, F.substring(body, at, F.length(body)))


def first_array(x: Column) -> Column:
    """The reply from its first '[' if no '{' stands before it."""
    body = _unfenced(x)
    a, o = F.locate("[", body), F.locate("{", body)
    return F.when((a > 0) & ((o == 0) | (a < o)), F.substring(body, a, F.length(body)))


def as_list(x: Column, element: str) -> Column:
    """Parsed array; a single object makes an array of one."""
    many, one = F.from_json(first_array(x), f"array<{element}>"), F.from_json(first_object(x), element)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def outer_slice(x: Column) -> Column:
    """First '{' to last '}'."""
    return F.regexp_extract(x, r"(?s)\{.*\}", 0)


def strict_true(x: Column, name: str) -> Column:
    """Only the literal true counts."""
    return F.coalesce(F.from_json(first_object(x), f"`{name}` boolean")[name], F.lit(False))


def verdict(x: Column, name: str) -> Column:
    """struct<pass,reason>; a verdict without the literal is (false, invalid format)."""
    parsed = F.from_json(first_object(x), f"`{name}` boolean, reason string")
    good = parsed[name].isNotNull()
    return F.struct(F.coalesce(parsed[name], F.lit(False)).alias("pass"), F.when(good, F.coalesce(parsed["reason"], F.lit(""))).otherwise("invalid format").alias("reason"))


def score(raw: Column, low: int = 1, high: int = 5) -> Column:
    """Whole score from its JSON text: numbers are truncated, true is 1, strings must
    be whole numbers; out of range or anything else is null."""
    number = F.when(F.lower(raw) == "true", F.lit(1)).when(F.lower(raw) == "false", F.lit(0)).when(raw.rlike(r'^\s*"\s*[+-]?\d+\s*"\s*$'), F.regexp_extract(raw, r"([+-]?\d+)", 1).try_cast("int")).when(raw.rlike(r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), raw.try_cast("double").try_cast("int"))
    return F.when(number.between(low, high), number)


def decision(relevant: Column, answerable: Column, good: Column) -> Column:
    r, a, q = (F.coalesce(c, F.lit(False)) for c in (relevant, answerable, good))
    return F.when(~(r & a), "fail").when(~q, "revise").otherwise("pass")


def missing_fields(caption: Column, names=REQUIRED) -> Column:
    """Names of required fields that are null; a range must have two ends."""
    return F.array_compact(F.array(*[F.when(caption[n].isNull() | (F.size(caption[n]) != 2 if n == "time_range" else F.lit(False)), F.lit(n)) for n in names]))


CAPTION = "visual string, audio string, visual_description string, audio_description string, confidence string, evidence_strength string"


def normalized_caption(raw: Column, modality: Column, default: Column) -> Column:
    """Any reply as struct<visual,audio,confidence,evidence,status>. Plain text goes to
    its modality's side; text that looks like JSON but cannot be read is salvaged with
    low confidence and weak evidence, and so is an empty reply."""
    return once(F.from_json(first_object(raw), CAPTION), lambda j: _caption_told(j, raw, modality, default))


def _caption_told(j: Column, raw: Column, modality: Column, default: Column) -> Column:
    """The caption of a reply that was read as ``j``."""
    blank = F.length(F.trim(F.coalesce(raw, F.lit("")))) == 0

    def full(c: Column) -> Column:
        return F.when(F.length(F.trim(c)) > 0, c)

    visual = F.coalesce(full(j["visual_description"]), full(j["visual"]))
    audio = F.coalesce(full(j["audio_description"]), full(j["audio"]))
    parsed = visual.isNotNull() | audio.isNotNull()
    broken = blank | (~parsed & (raw.contains("{") | raw.contains("[")))
    heard = modality == "audio"
    return F.struct(
        F.when(parsed, F.coalesce(visual, F.lit(""))).when(~heard, F.coalesce(F.trim(raw), F.lit(""))).otherwise("").alias("visual_description"),
        F.when(parsed, F.coalesce(audio, F.lit(""))).when(heard, F.coalesce(F.trim(raw), F.lit(""))).otherwise("").alias("audio_description"),
        F.when(broken, "low").otherwise(F.coalesce(F.when(parsed, enum_or(j["confidence"], domains.CONFIDENCE_RANK, "low")), default)).alias("confidence"),
        F.when(broken, "weak").otherwise(F.when(parsed, enum_or(j["evidence_strength"], domains.EVIDENCE_RANK, "ambiguous")).otherwise("ambiguous")).alias("evidence_strength"),
        F.when(broken, "salvaged").otherwise("normalized").alias("status"),
    )


def merged_caption(audio: Column, video: Column, default: Column) -> Column:
    """A video model's reply with an audio model's text beside it, cleared of emotion
    words; status 'merged' if there is such a text."""
    c, heard = normalized_caption(video, F.lit("video"), default), F.trim(F.coalesce(audio, F.lit("")))
    has = F.length(heard) > 0
    return c.withField("audio_description", F.when(has, scrubbed(heard)).otherwise(c["audio_description"])).withField("status", F.when(has, "merged").otherwise(c["status"]))


def caption_of(modality: Column, raw: Column, audio: Column, video: Column, model: Column) -> Column:
    """A model's reply by its modality, with its model's default confidence."""
    default = F.coalesce(F.create_map(*[F.lit(x) for m, (_, _, _, d) in domains.MODELS.items() for x in (m, d)])[model], F.lit("low"))
    return F.when(modality == "audio_video", merged_caption(audio, video, F.lit("low"))).otherwise(normalized_caption(raw, modality, default))
