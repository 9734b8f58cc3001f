"""Text predicates and rewrites as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def once(x: Column, use) -> Column:
    """``use(x)`` with x worked out once however often ``use`` names it."""
    return F.transform(F.array(x), use)[0]


def normalized(x: Column) -> Column:
    """Lower case, ASCII punctuation deleted, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), PUNCTUATION, ""), r"\s+", " "))


def words(x: Column) -> Column:
    """Words of the normalized text; none for ''."""
    n = normalized(x)
    return F.when(F.length(n) > 0, F.split(n, " ")).otherwise(F.array().cast("array<string>"))


def leading_phrase(x: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger set; 0 if either is empty."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def has_word(x: Column, vocabulary) -> Column:
    """Whether any of the words stands in the text as a whole word."""
    return F.coalesce(F.lower(x).rlike(rf"\b(?:{domains.alternation(vocabulary)})\b"), F.lit(False))


def guardrail_reverts(original: Column, refined: Column) -> Column:
    """A refined text is taken back if it lost its emotion word or gained a forbidden one."""
    lost = has_word(original, domains.EMOTION_WORDS) & ~has_word(refined, domains.EMOTION_WORDS)
    return lost | has_word(refined, domains.FORBIDDEN_WORDS)


_LEAK = domains.alternation(domains.LEAK_WORDS)
# Rewrites in the order in which they apply.
SCRUB = (
    (
        r"(?i)[,;]?\s*\b(?:express(?:ing|es|ed)?|convey(?:ing|s|ed)?|suggest(?:ing|s|ed)?|indicat(?:ing|es|ed)?|signal(?:l?ing|s|led)?|"
        rf"reflect(?:ing|s|ed)?|showing|denoting|with (?:a )?(?:sense|feeling|air|tone) of)\b[^.,;]*?\b(?:{_LEAK})\b[^.,;]*",
        "",
    ),
    (rf"(?i)\b(?:clearly|seemingly|apparently|visibly|slightly|very|quite|somewhat)?\s*\b(?:{_LEAK})\b", ""),
    (r"([.,;])\s*[.,;]+", "$1"),
    (r"\s+([.,;])", "$1"),
    (r"\s{2,}", " "),
    (r"(?i)\b(a|an)\s*,\s*(?=[a-z])", "$1 "),
    (r"\b(?:a|an|and|or|with|of)\s+([.,;])", "$1"),
    (r"^\s+|\s+$", ""),
    (r"\s+(?:and|or)\s*$", ""),
    (r"^[ ,;]+|[ ,;]+$", ""),
    (r"^\s+|\s+$", ""),
)


def scrubbed(x: Column) -> Column:
    """Text without inferred-emotion words and clauses; null and '' stay."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), SCRUB, x)


# How a reply names a span.
PAIR = r"(?i)(\d+(?:\.\d+)?)\s*(?:seconds?)?\s*(?:to|-|–|and)\s*(\d+(?:\.\d+)?)\s*seconds?"
CLOCK = r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b"
NUMBER = r"\d+(?:\.\d+)?"


def _ordered(a: Column, b: Column) -> Column:
    return F.when(a != b, F.array(F.least(a, b), F.greatest(a, b)))


def time_span(x: Column) -> Column:
    """[start, end] that a reply names: a pair with 'seconds', else two clock times,
    else its first two numbers. A pair that is found but has equal ends is null, and
    so is a single clock time: the search does not go on."""
    p = [F.regexp_extract(x, PAIR, i).try_cast("double") for i in (1, 2)]

    def seconds(text: Column) -> Column:
        a, b, c = (F.regexp_extract(text, CLOCK, i).try_cast("double") for i in (1, 2, 3))
        return F.when(c.isNotNull(), a * 3600 + b * 60 + c).otherwise(a * 60 + b)

    clocks = F.regexp_extract_all(x, F.lit(CLOCK), F.lit(0))
    numbers = F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))
    first, second = (F.get(clocks, F.lit(i)) for i in (0, 1))
    n1, n2 = (F.get(numbers, F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(x.rlike(PAIR), _ordered(*p)).when(F.size(clocks) > 0, _ordered(seconds(first), seconds(second))).otherwise(_ordered(n1, n2))


def segment_span(x: Column, duration: Column, cell: float = 5.0) -> Column:
    """Span of the cells that a reply cites as s000, s001, ..."""
    ids = F.transform(F.regexp_extract_all(x, F.lit(r"s(\d{3})"), F.lit(1)), lambda i: i.cast("int"))
    return F.when(F.size(ids) > 0, F.array(F.array_min(ids) * cell, F.least((F.array_max(ids) + 1) * cell, duration)))


def cited_segments(x: Column) -> Column:
    """Segment ids of a leading '[s001, s002]'."""
    return F.regexp_extract_all(F.regexp_extract(x, r"^\s*\[([^\]]*)\]", 1), F.lit(r"s\d+"), F.lit(0))


def cited_segment(x: Column) -> Column:
    """The segment of a cue's leading '[s001]', '' without one."""
    return F.regexp_extract(x, r"^\s*\[(s\d+)\]", 1)


def range_in_text(x: Column) -> Column:
    """[a, b] of the first '(a - b s)'."""
    a, b = (F.regexp_extract(x, r"\(([\d.]+)\s*-\s*([\d.]+)\s*s\)", i).try_cast("double") for i in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.array(a, b))


def without_reasoning(x: Column) -> Column:
    """What follows the last </think>, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?s)^.*</think>", ""))


def says_yes(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)^\s*yes"), F.lit(False))


def not_present(x: Column) -> Column:
    return F.coalesce(F.lower(x).contains("not present"), F.lit(False))


def target_key(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def enum_or(x: Column, domain, default: str) -> Column:
    return F.when(x.isin(*domain), x).otherwise(default)


def routed(x: Column, modality: Column) -> Column:
    """struct<visual,audio>: plain text goes to one side by modality."""
    audio = modality == "audio"
    return F.struct(F.when(~audio, x).alias("visual"), F.when(audio, x).alias("audio"))


def folded_scenes(scenes: Column) -> Column:
    """Scenes (timestamp, segment_detail_caption, storyline, acoustics_content) as
    lines; null if no scene has a detail."""

    def has(c: Column) -> Column:
        return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))

    def line(s: Column) -> Column:
        parts = (
            F.when(has(s["timestamp"]), F.concat(F.lit("("), s["timestamp"], F.lit(") "))),
            F.trim(s["segment_detail_caption"]),
            F.when(has(s["storyline"]), F.concat(F.lit(" (Storyline: "), F.trim(s["storyline"]), F.lit(")"))),
            F.when(has(s["acoustics_content"]), F.concat(F.lit(" (Audio: "), F.trim(s["acoustics_content"]), F.lit(")"))),
        )
        return F.concat_ws("", *parts)

    lines = F.transform(F.filter(scenes, lambda s: has(s["segment_detail_caption"])), line)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def payload(visual: Column, audio: Column) -> Column:
    """'Visual: ...' and 'Audio: ...' lines; a blank side has none."""

    def side(name: str, c: Column) -> Column:
        return F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{name}: "), F.trim(c)))

    return F.concat_ws("\n", side("Visual", visual), side("Audio", audio))


def caption_span(own: Column, start: Column, end: Column) -> Column:
    """A caption's range if it has two ends, else its segments' (null if unknown),
    rounded to hundredths."""
    known = F.when(start.isNotNull() & end.isNotNull(), F.array(start, end))
    return F.transform(F.coalesce(F.when(F.size(own) == 2, own), known), lambda x: F.round(x, 2))


def visual_prose(people: Column, scene: Column, expressions: Column, temporal: Column) -> Column:
    """Prose for a structured caption: people (person, action), scene (location,
    setting), expressions (person, facial_cues, body_cues) and a temporal description;
    empty parts are left out."""

    def full(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)

    def cues(e: Column) -> Column:
        all_ = F.filter(F.concat(F.coalesce(e["facial_cues"], F.array()), F.coalesce(e["body_cues"], F.array())), lambda c: F.length(c) > 0)
        who = F.coalesce(F.concat(full(e["person"]), F.lit(": ")), F.lit(""))
        return F.when(F.size(all_) > 0, F.concat(who, F.array_join(all_, ", ")))

    who = F.transform(people, lambda p: full(F.trim(F.concat_ws(" ", full(p["person"]), full(p["action"])))))
    place = F.concat(F.lit("Scene: "), full(F.concat_ws(" ", full(scene["location"]), full(scene["setting"]))))
    return F.trim(F.concat_ws(" ", who, place, F.transform(expressions, cues), full(F.trim(temporal))))


def clip_lines(segments: Column) -> Column:
    """'Clip i -> id (a-bs)' lines of an array of (segment_id, start_time, end_time)."""
    return F.array_join(F.transform(segments, lambda s, i: F.format_string("Clip %d -> %s (%.2f-%.2fs)", i + 1, s["segment_id"], s["start_time"], s["end_time"])), "\n")


def grid_lines(duration: Column, cell: float = 5.0) -> Column:
    """'s000: 0-5s' lines, numbered from 0, seconds rounded half to even."""
    n = F.ceil(duration / cell).cast("int")
    whole = lambda x: F.bround(x, 0).cast("long")
    line = lambda i: F.format_string("s%03d: %d-%ds", i, whole(i * F.lit(float(cell))), whole(F.least((i + 1) * F.lit(float(cell)), duration)))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), line), "\n")).otherwise("")


def time_label(span: Column) -> Column:
    """'a-bs' with plain numbers, '' for anything but two ends."""

    def number(c: Column) -> Column:
        return F.regexp_replace(c.cast("string"), r"\.0$", "")

    return F.when(F.size(span) == 2, F.concat(number(span[0]), F.lit("-"), number(span[1]), F.lit("s"))).otherwise("")


def rendered(template: str, **values: Column) -> Column:
    """A prompt template with each {name} replaced."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))


def preview(x: Column, n: int) -> Column:
    return F.left(x, F.lit(n))
