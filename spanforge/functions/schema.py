"""Declared shapes of JSON values, compiled to column expressions that name what is wrong.

A shape says what a value must be; ``broken`` gives the first rule that a value breaks,
``checked`` the reason why a document counts as unusable.  All of it is evaluated in
the JVM on a VARIANT that is parsed once a row.  Numbers and truth values are taken as
leniently as the records do: a number may stand in a string, a truth value may be 0, 1
or one of a few words; texts must be texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains, json_text
from .text import once

# Why a document is not used.
NOT_FOUND, UNREADABLE, MISSING, INVALID = "not_found", "json_parse_error", "missing_required_fields", "schema_validation_error"

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"
_TRUTHS = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")


@dataclass(frozen=True)
class Is:
    """A value: ``kind`` is string, number, whole, boolean, array, object or any.

    required: absent or null counts as missing; otherwise absent is fine, and null is
    fine only if ``nullable``. one_of: its domain. low, high: inclusive bounds. size:
    inclusive bounds of an array's or text's length (``sized``: breaking them, or not
    being an array, counts as missing). items: each element. fields: of an object."""

    kind: str = "any"
    required: bool = False
    nullable: bool = False
    one_of: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    size: tuple[int, int] | None = None
    sized: bool = False
    items: Is | None = None
    fields: dict[str, Is] = field(default_factory=dict)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _kind(v: Column) -> Column:
    """The type of a value; null where there is none."""
    return F.schema_of_variant(v)


def _of_kind(v: Column, declared: Is) -> Column:
    kind = _kind(v)
    number = F.try_variant_get(v, "$", "double")
    if declared.kind == "string":
        return kind == "STRING"
    if declared.kind == "number":
        return kind.rlike(_NUMBER) | ((kind == "STRING") & F.trim(_text(v)).try_cast("double").isNotNull())
    if declared.kind == "whole":
        text = F.trim(_text(v)).rlike(r"^[+-]?\d+(\.0*)?$")
        return ((kind != "STRING") & kind.rlike(_NUMBER) & (number == F.floor(number))) | ((kind == "STRING") & text)
    if declared.kind == "boolean":
        return (kind == "BOOLEAN") | (kind.isin("STRING", "BIGINT") & F.lower(_text(v)).isin(*_TRUTHS))
    if declared.kind == "array":
        return kind.startswith("ARRAY")
    if declared.kind == "object":
        return kind.startswith("OBJECT")
    return F.lit(True)


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _first(rules: list[Column]) -> Column:
    return F.coalesce(*rules) if rules else F.lit(None).cast("string")


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _present(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def missing(v: Column, fields: dict[str, Is]) -> Column:
    """The names of required fields of an object that are missing."""

    def gone(name: str, declared: Is) -> Column:
        x = _member(v, name)
        out = ~_present(x)
        if declared.sized and declared.size:
            out = out | ~F.coalesce(_kind(x).startswith("ARRAY"), F.lit(False)) | ~F.coalesce(F.size(_array(x)).between(*declared.size), F.lit(False))
        return F.when(out, F.lit(name))

    return F.array_compact(F.array(*[gone(n, d) for n, d in fields.items() if d.required]).cast("array<string>"))


def broken(v: Column, declared: Is, name: str = "value") -> Column:
    """The first rule that a present value breaks, as ``name: rule``; null if none.
    Elements and members are looked at after the value itself."""

    def rule(bad: Column, what: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name}: {what}"))

    rules = [rule(~F.coalesce(_of_kind(v, declared), F.lit(False)), f"not {'an' if declared.kind[0] in 'aeo' else 'a'} {declared.kind}")]
    if declared.one_of:
        rules.append(rule(~_text(v).isin(*declared.one_of), "not one of " + ", ".join(declared.one_of)))
    number = F.trim(_text(v)).try_cast("double")
    if declared.low is not None:
        rules.append(rule(number < declared.low, f"below {declared.low:g}"))
    if declared.high is not None:
        rules.append(rule(number > declared.high, f"above {declared.high:g}"))
    if declared.size is not None:
        size = F.size(_array(v)) if declared.kind == "array" else F.char_length(_text(v))
        rules.append(rule(~size.between(*declared.size), f"not of size {declared.size[0]} to {declared.size[1]}"))
    if declared.items is not None:
        element = lambda x: F.when(_present(x), broken(x, declared.items, f"{name}[]")).otherwise(F.lit(None if declared.items.nullable else f"{name}[]: null"))
        rules.append(F.try_element_at(F.array_compact(F.transform(_array(v), element)), F.lit(1)))
    if declared.fields:
        rules.append(members(v, declared.fields, name))
    return _first(rules)


def members(v: Column, fields: dict[str, Is], name: str = "") -> Column:
    """The first rule that an object's fields break, required ones first."""
    place = lambda n: f"{name}.{n}" if name else n
    lost = F.concat(F.try_element_at(missing(v, fields), F.lit(1)), F.lit(": missing"))
    rules = [F.concat(F.lit(f"{name}."), lost) if name else lost]
    for n, declared in fields.items():
        x = _member(v, n)
        null = F.lit(None).cast("string") if declared.nullable or declared.required else F.when(F.is_variant_null(x), F.lit(f"{place(n)}: null"))
        rules.append(F.when(_present(x), broken(x, declared, place(n))).otherwise(null))
    return _first(rules)


def judged(v: Column, fields: dict[str, Is]) -> Column:
    """struct<reason, rule> of a parsed document: json_parse_error if it is no object."""
    rule = members(v, fields)
    readable = F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))
    reason = F.when(~readable, UNREADABLE).when(F.size(missing(v, fields)) > 0, MISSING).when(rule.isNotNull(), INVALID)
    return F.struct(reason.alias("reason"), F.when(readable, rule).alias("rule"))


def checked(raw: Column, fields: dict[str, Is]) -> Column:
    """struct<reason, rule> of a JSON document: ``reason`` is null for a good one, else
    not_found (no text), json_parse_error (no JSON object), missing_required_fields or
    schema_validation_error; ``rule`` says which field and what."""
    verdict = once(F.try_parse_json(raw), lambda v: judged(v, fields))
    return verdict.withField("reason", F.when(raw.isNull(), NOT_FOUND).otherwise(verdict["reason"]))


def _without(m: Column, name: str) -> Column:
    return F.map_filter(m, lambda k, _: k != name)


def filled(v: Column, *pairs: tuple[str, str]) -> Column:
    """An object where, for each (of, to), the text of ``of`` stands for an empty ``to``."""
    m = F.try_variant_get(v, "$", "map<string,variant>")
    for of, to in pairs:
        own, other = _member(v, to), _member(v, of)
        empty = ~_present(own) | (_text(own) == "")
        use = empty & (_kind(other) == "STRING") & (F.length(F.trim(_text(other))) > 0)
        rest = _without(m, to)
        m = F.when(F.coalesce(use, F.lit(False)), F.map_concat(rest, F.create_map(F.lit(to), _text(other).cast("variant")))).otherwise(m)
    return F.to_variant_object(m)


CONFIDENCE, EVIDENCE = tuple(domains.CONFIDENCE_RANK), tuple(domains.EVIDENCE_RANK)
_TEXTS = Is("array", items=Is("string"))
_ANY = Is("array", items=Is("any", nullable=True))
CAPTION = {
    "video_id": Is("string"),
    "segment_id": Is("string", required=True),
    "time_range": Is("array", required=True, size=(2, 2), sized=True, items=Is("number")),
    "visual_description": Is("string", required=True),
    "audio_description": Is("string", required=True),
    "confidence": Is("string", required=True, one_of=CONFIDENCE),
    "evidence_strength": Is("string", required=True, one_of=EVIDENCE),
    "temporal_description": Is("string"),
    "visual_objective": Is(
        "object",
        fields={
            "people": Is("array", items=Is("object", fields={n: Is("string") for n in ("person", "visibility", "position", "action")})),
            "scene": Is("object", fields={"location": Is("string"), "setting": Is("string")}),
            **{n: _ANY for n in ("objects", "interactions", "key_actions")},
            "visibility_notes": Is("string"),
        },
    ),
    "visual_expression": Is("array", items=Is("object", fields={"person": Is("string"), "facial_cues": _ANY, "body_cues": _ANY, "gaze": Is("string")})),
}
EVENT = {
    "video_id": Is("string"),
    "event_id": Is("string", nullable=True),
    "emotion_label": Is("string", required=True, one_of=domains.EMOTIONS),
    "event_description": Is("string", required=True),
    "time_range": Is("array", nullable=True, items=Is("number")),
    "target_person_or_group": Is("string"),
    "visual_evidence": _TEXTS,
    "audio_evidence": _TEXTS,
    "confidence": Is("string", one_of=CONFIDENCE),
    "evidence_strength": Is("string", one_of=EVIDENCE),
    "segment_ids": _TEXTS,
}


def strict_caption(raw: Column, video_id: Column, segment_id: Column, start: Column, end: Column) -> Column:
    """struct<caption, reason, rule>: the reply's first JSON object as a caption, with the
    segment's own ids and span whatever the reply says; null with the reason why not.
    ``visual`` and ``audio`` stand for empty descriptions."""
    found = once(F.try_parse_json(F.get_json_object(json_text.first_object(raw), "$")), lambda v: filled(v, ("visual", "visual_description"), ("audio", "audio_description")))

    def judge(v: Column) -> Column:
        verdict = judged(v, CAPTION)
        texts = [_text(_member(v, n)).alias(n) for n in ("visual_description", "audio_description", "confidence", "evidence_strength")]
        caption = F.struct(video_id.alias("video_id"), segment_id.alias("segment_id"), F.array(F.round(start, 2), F.round(end, 2)).alias("time_range"), *texts)
        return F.struct(F.when(verdict["reason"].isNull(), caption).alias("caption"), verdict["reason"].alias("reason"), verdict["rule"].alias("rule"))

    return once(found, judge)


def good_events(raw: Column) -> Column:
    """array<struct<pos, event, rule>> of a reply {"events": [...]}: each event's JSON with the
    first rule it breaks; what is no object is left out, as its place is not."""
    items = F.try_variant_get(F.try_parse_json(F.get_json_object(json_text.first_object(raw), "$")), "$.events", "array<variant>")
    each = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v, i: F.struct((i + 1).alias("pos"), F.to_json(v).alias("event"), F.when(F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), F.coalesce(members(v, EVENT), F.lit(""))).alias("rule")))
    kept = F.filter(each, lambda e: e["rule"].isNotNull())
    return F.transform(kept, lambda e: F.struct(e["pos"].alias("pos"), e["event"].alias("event"), F.nullif(e["rule"], F.lit("")).alias("rule")))
