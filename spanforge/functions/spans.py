"""Time grid and span arithmetic as column expressions.

A span is ``[start, end]`` in seconds; overlap is half-open. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPS = 1e-6


def grid(duration: Column, window: float, stride: float) -> Column:
    """array<struct<index,start,end>>: windows every ``stride``; a window that the
    duration cuts short stands last. Closed form, no loop."""
    d = duration.cast("double")
    whole = F.when(d + _EPS >= window, F.floor((d + _EPS - window) / stride) + 1).otherwise(0).cast("int")
    tail = (whole * stride < d - _EPS).cast("int")
    n = whole + tail
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("index"), F.round(i * stride, 6).alias("start"), F.round(F.least(i * stride + window, d), 6).alias("end"))),
    ).otherwise(F.array().cast("array<struct<index:int,start:double,end:double>>"))


def plan_segments(videos: DataFrame, window: float, stride: float, least: float = 1.0) -> DataFrame:
    """(video_id, duration) -> one row a segment of at least ``least`` seconds."""
    w = videos.select("video_id", F.inline(grid(F.col("duration"), window, stride)))
    w = w.where(F.round(F.col("end") - F.col("start"), 6) >= least)
    return w.select("video_id", segment_id(F.col("index")).alias("segment_id"), "index", F.col("start").alias("start_time"), F.col("end").alias("end_time"))


def segment_id(index: Column) -> Column:
    return F.format_string("s%03d", index + 1)


def grid_span(segment: Column, seconds: float = 5.0) -> Column:
    """struct<start,end,index> of a segment id on a fixed grid; an id without digits
    is the first."""
    n = F.coalesce(F.regexp_extract(segment, r"s(\d+)", 1).try_cast("int"), F.lit(1))
    return F.struct(((n - 1) * F.lit(float(seconds))).alias("start"), (n * F.lit(float(seconds))).alias("end"), n.alias("index"))


def clip_name(segment: Column, index: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s_%03d_%.2f_%.2f.mp4", segment, index, start, end)


def grid_key(window: Column, stride: Column) -> Column:
    return F.format_string("win%.2f_str%.2f", window.cast("double"), stride.cast("double"))


def grid_key_of(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Grid key per video, read off its rows in order of ``index``: longest window;
    stride from the first two starts, else the window."""
    starts = F.sort_array(F.collect_list(F.struct("index", "start_time")))
    g = segments.groupBy(key).agg(F.max(F.col("end_time") - F.col("start_time")).alias("w"), starts.alias("s"))
    stride = F.when(F.size("s") > 1, F.col("s")[1]["start_time"] - F.col("s")[0]["start_time"]).otherwise(F.col("w"))
    return g.select(key, grid_key(F.col("w"), stride).alias("grid_key"))


def scan_windows(duration: Column, window: float, stride: float, least: float = 3.0) -> Column:
    """Starts every ``stride``, each as long as is left; short ones go."""
    n = F.ceil(duration / stride).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i * stride).alias("start"), F.least(F.lit(window), duration - i * stride).alias("length")))
    return F.filter(parts, lambda p: p["length"] >= least)


def clamp(x: Column, top: Column) -> Column:
    """x within 0 and top; null stays null (least and greatest alone skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0)), top))


def valid_span(start: Column, end: Column) -> Column:
    """Whether a span has both ends and a positive length (never null)."""
    return F.coalesce(end > start, F.lit(False))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over hull; 0 where either is missing or the hull is empty."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    whole = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.coalesce(F.when(whole & (hull > 0), overlap(s1, e1, s2, e2).cast("double") / hull), F.lit(0.0))


def merged(ranges) -> Column:
    """An array of spans (arrays of two numbers) with those that touch or overlap as one."""
    rows = F.array_sort(F.filter(ranges, lambda r: r[0].isNotNull()))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = lambda acc, r: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], r[1]))))
    return F.aggregate(rows, F.array().cast("array<array<double>>"), lambda acc, r: F.when((F.size(acc) > 0) & (r[0] <= last(acc)[1]), joined(acc, r)).otherwise(F.concat(acc, F.array(r))))


def max_iou(pred: Column, gold: Column) -> Column:
    """Best IoU of a span with an array of spans (arrays of two numbers)."""
    best = F.array_max(F.transform(gold, lambda g: iou(pred[0], pred[1], g[0], g[1])))
    return F.coalesce(best, F.lit(0.0))


def cells(start: Column, end: Column, duration: Column, cell: float = 5.0) -> Column:
    """Grid cells of a span: those it covers for half of min(cell, its length) or
    more; the cell of its start if none is."""
    last_cell = F.greatest(F.ceil(duration / cell).cast("int") - 1, F.lit(0))
    first = F.least(F.floor(start / cell).cast("int"), last_cell)
    last = F.greatest(first, F.least(F.ceil(end / cell).cast("int") - 1, last_cell))
    need = F.least(F.lit(cell), end - start) / 2
    got = F.filter(F.sequence(first, last), lambda i: overlap(start, end, i * F.lit(cell), (i + 1) * F.lit(cell)) >= need)
    return F.when(F.size(got) > 0, got).otherwise(F.array(first))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def duration(start: Column, end: Column) -> Column:
    """Length of a span, to six decimals."""
    return F.round(end - start, 6)


def adhoc_segment(segment_id: Column, start: Column, end: Column) -> Column:
    """A segment as a struct; its index is the digits of its id, 1 without any."""
    digits = F.regexp_replace(segment_id, r"\D", "")
    index = F.coalesce(F.try_to_number(F.nullif(digits, F.lit("")), F.lit("9999999999")).cast("int"), F.lit(1))
    return F.struct(segment_id.alias("segment_id"), index.alias("index"), F.round(start.cast("double"), 6).alias("start_time"), F.round(end.cast("double"), 6).alias("end_time"))
