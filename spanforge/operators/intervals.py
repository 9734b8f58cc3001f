"""Interval joins and merges. Each takes the video as its equality key, so the range
condition is a residual of a hash or merge join and one exchange serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains


def overlap_join(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str], how: str = "inner") -> DataFrame:  # noqa: E741
    """Rows of equal ``key`` whose half-open spans overlap. ``r`` columns must be
    named differently from ``left``'s; the right key is dropped."""
    rk = f"__{key}"
    right = right.withColumnRenamed(key, rk)
    hit = (left[key] == right[rk]) & (right[r[0]] < left[l[1]]) & (right[r[1]] > left[l[0]])
    return left.join(right, hit, how).drop(rk)


def resolved(items: DataFrame, segments: DataFrame, key: str, item: str, keep_unmatched: bool) -> DataFrame:
    """(key, item, start, end) and segments (key, segment_id, index, start_time,
    end_time): the covering segments of each item in index order. Unmatched items
    go, or stay with an empty list."""
    joined = overlap_join(items, segments, key, ("start", "end"), ("start_time", "end_time"), "left" if keep_unmatched else "inner")
    ids = F.sort_array(F.collect_list(F.when(F.col("segment_id").isNotNull(), F.struct("index", "segment_id"))))
    g = joined.groupBy(key, item, "start", "end").agg(ids.alias("s"))
    return g.select(key, item, "start", "end", F.transform("s", lambda x: x["segment_id"]).alias("segment_ids"))


def islands(events: DataFrame, video: str, start: str, end: str, order: list[str], same: list[Column], gap: Column) -> DataFrame:
    """Adds ``island`` (0, 1, ... within the video). A row joins the island of the row
    before it in the whole video if its ``same`` expressions are equal and it starts no
    later than ``gap`` after the island's end so far; otherwise it opens one."""
    w = Window.partitionBy(video).orderBy(*order)
    rows = events
    changed = F.lit(False)
    for i, expr in enumerate(same):
        rows = rows.withColumn(f"__k{i}", expr)
        changed = changed | ~F.col(f"__k{i}").eqNullSafe(F.lag(f"__k{i}").over(w))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__c", (changed | (F.row_number().over(w) == 1)).cast("int")).withColumn("__run", F.sum("__c").over(up_to))
    inside = Window.partitionBy(video, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(inside)
    rows = rows.withColumn("__b", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    rows = rows.withColumn("island", (F.sum("__b").over(up_to) - 1).cast("int"))
    return rows.drop("__c", "__run", "__b", *[f"__k{i}" for i in range(len(same))])


def fold_events(rows: DataFrame, video: str) -> DataFrame:
    """One event an island: hull, descriptions joined in order (a repeat of all that
    was joined so far, or an empty one, is skipped), evidence united in order, and the
    highest confidence and evidence strength, the first of equals."""

    def ranked(column: str, rank: dict[str, int]) -> Column:
        value = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col(column)]
        return F.max_by(column, F.struct(value, -F.col("pos")))

    g = rows.groupBy(video, "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("label", "pos").alias("label"),
        F.sort_array(F.collect_list(F.struct("pos", "description", "evidence"))).alias("parts"),
        ranked("confidence", domains.CONFIDENCE_RANK).alias("confidence"),
        ranked("evidence_strength", domains.EVIDENCE_RANK).alias("evidence_strength"),
        F.count(F.lit(1)).alias("n"),
    )
    text = F.aggregate("parts", F.lit(""), lambda acc, p: F.when((F.coalesce(p["description"], F.lit("")) == "") | (acc == p["description"]), acc).when(acc == "", p["description"]).otherwise(F.concat_ws(" ", acc, p["description"])))
    evidence = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.coalesce(p["evidence"], F.array().cast("array<string>")))))
    return g.select(video, "island", "start", "end", "label", text.alias("description"), evidence.alias("evidence"), "confidence", "evidence_strength", "n")


def span_union(spans: DataFrame, key: str, start: str = "start", end: str = "end", slack: float = 0) -> DataFrame:
    """Union of spans per key; spans at most ``slack`` apart join."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    rows = spans.withColumn("__b", F.when(reach.isNull() | (F.col(start) > reach + slack), 1).otherwise(0)).withColumn("__g", F.sum("__b").over(up_to))
    return rows.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__g")


def cluster_vote(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """The best cluster per key: a new one begins where a span starts after the end of
    the one just before it; most spans, then longest extent, then earliest."""
    w = Window.partitionBy(key).orderBy(start, end)
    rows = spans.withColumn("__b", F.when(F.lag(end).over(w).isNull() | (F.col(start) > F.lag(end).over(w)), 1).otherwise(0))
    rows = rows.withColumn("__g", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("support"))
    best = F.max_by(F.struct(start, end, "support"), F.struct(F.col("support"), F.col(end) - F.col(start), -F.col("__g")))
    return g.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def candidate_band(queries: DataFrame, segments: DataFrame, key: str, window: int) -> DataFrame:
    """(key, query_id, segment_ids) and (key, segment_id, index): segments within
    ``window`` places of those a query cites; all if it cites no known one."""
    ranked = segments.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("index")))
    cited = queries.select(key, "query_id", F.explode_outer("segment_ids").alias("segment_id")).join(ranked, [key, "segment_id"], "left")
    span = cited.groupBy(key, "query_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    near = span.join(ranked, key).where(F.col("lo").isNull() | F.col("rank").between(F.col("lo") - window, F.col("hi") + window))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "segment_id"))), lambda s: s["segment_id"])
    return near.groupBy(key, "query_id").agg(ids.alias("candidates"))


def valid_selection(chosen: Column, index: Column, allowed: Column) -> Column:
    """Whether a re-grounding choice stands: some ids, all allowed, none twice, and
    consecutive indices (``index`` is the array of their positions)."""
    return (F.size(chosen) > 0) & (F.size(F.array_except(chosen, allowed)) == 0) & (F.size(chosen) == F.size(F.array_distinct(chosen))) & (F.array_max(index) - F.array_min(index) + 1 == F.size(chosen))
