"""Judges' and verifiers' replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_text import decision, first_object, score
from .text import once

CAPTION_DIMENSIONS = {"faithfulness": (1, 5), "hallucination": (1, 5), "coverage": (1, 5), "fluency": (1, 5), "emotion_leakage_ok": (0, 1)}
EVENT_DIMENSIONS = {"cue_sufficiency": (1, 5), "cue_grounded": (1, 5)}
_NO_OBJECT = "response is not a JSON object"


def _text(v: Column) -> Column:
    """A JSON value as text: strings as they are, others as JSON, '' for none."""
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)), F.lit(""))


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _scored(reply: Column, dims: dict[str, tuple[int, int]]) -> list[Column]:
    """A struct (score, reason) for each dimension."""

    def within(bounds: tuple[int, int]):
        return lambda x: score(x, *bounds)

    parts = []
    for name, bounds in dims.items():
        s = once(F.to_json(_part(reply[name], "score")), within(bounds))
        parts.append(F.struct(s.alias("score"), _text(_part(reply[name], "reason")).alias("reason")).alias(name))
    return parts


def _read(raw: Column, names, use) -> Column:
    """``use(reply, problem)`` of a reply parsed once, its parts as variants."""
    parsed = once(first_object(raw), lambda body: F.struct(F.from_json(body, ", ".join(f"{n} variant" for n in names)).alias("reply"), F.when(body.isNull(), _NO_OBJECT).alias("bad")))
    return once(parsed, lambda p: use(p["reply"], p["bad"]))


def _with_problem(parts: list[Column], names: list[str], bad: Column) -> Column:
    """The parts and the first problem: no object, else the first part without a score."""
    problems = lambda s: [F.when(s[n]["score"].isNull(), f"missing/invalid dimension: {n}") for n in names]
    return once(F.struct(*parts), lambda s: F.struct(*[s[n].alias(n) for n in names], F.coalesce(bad, *problems(s)).alias("parse_error")))


def caption_verdict(raw: Column) -> Column:
    """struct of (score, reason) a dimension and ``parse_error``, the first problem met."""
    dims = CAPTION_DIMENSIONS
    return _read(raw, dims, lambda reply, bad: _with_problem(_scored(reply, dims), list(dims), bad))


def event_verdict(raw: Column, assigned: Column) -> Column:
    """The same for events; agreement is worked out here: the label that the judge
    picked against the assigned one, whatever case and outer spaces."""
    wanted = F.lower(F.trim(F.coalesce(assigned, F.lit(""))))

    def agreement(own: Column) -> Column:
        picked = _part(own, "predicted_label")
        label = F.trim(F.when(F.schema_of_variant(picked) == "STRING", F.try_variant_get(picked, "$", "string")))
        return once(F.when(F.length(label) > 0, label), lambda x: F.struct((F.lower(x) == wanted).cast("int").alias("score"), _text(_part(own, "reason")).alias("reason"), x.alias("predicted_label")))

    names = [*EVENT_DIMENSIONS, "label_agreement"]
    return _read(raw, names, lambda reply, bad: _with_problem([*_scored(reply, EVENT_DIMENSIONS), agreement(reply["label_agreement"]).alias("label_agreement")], names, bad))


_RESULT = "video_id:string,round_index:int,query_id:string,emotion_relevance_pass:variant,answerability_pass:variant,query_quality_pass:variant,failure_reason:string,suggested_revision:string"


def verification_results(raw: Column, video_id: Column, round_index: Column) -> Column:
    """array of results with defaults filled in; only a literal true passes, and the
    decision follows from the three passes, whatever the verifier says."""
    found = F.from_json(first_object(raw), f"results array<struct<{_RESULT}>>")["results"]

    def one(r: Column) -> Column:
        passed = {n: F.coalesce(F.to_json(r[n]) == "true", F.lit(False)) for n in ("emotion_relevance_pass", "answerability_pass", "query_quality_pass")}
        return F.struct(
            F.coalesce(r["video_id"], video_id).alias("video_id"),
            F.coalesce(r["round_index"], round_index).alias("round_index"),
            r["query_id"].alias("query_id"),
            *[v.alias(n) for n, v in passed.items()],
            F.coalesce(r["failure_reason"], F.lit("")).alias("failure_reason"),
            F.coalesce(r["suggested_revision"], F.lit("")).alias("suggested_revision"),
            decision(*passed.values()).alias("decision"),
        )

    return F.transform(found, one)


def rewrites(raw: Column, video_id: Column, round_index: Column) -> Column:
    """array of rewrites with the video and round filled in."""
    own = ("query_id", "original_query_text", "rewritten_query_text", "query_type", "rewrite_reason")
    found = F.from_json(first_object(raw), f"rewrites array<struct<video_id:string,round_index:int,{','.join(f'{c}:string' for c in own)}>>")["rewrites"]
    return F.transform(found, lambda r: F.struct(F.coalesce(r["video_id"], video_id).alias("video_id"), F.coalesce(r["round_index"], round_index).alias("round_index"), *[r[c].alias(c) for c in own]))
