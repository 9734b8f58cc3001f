"""Run statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(column, n, pct): counts with their share in percent."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def as_map(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """One row with a map of string keys, sorted."""
    pair = F.struct(F.col(key).cast("string").alias("k"), F.col(n).alias("v"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("counts"))


def run_stats(segments, captions, events, queries, traces, verdicts) -> DataFrame:
    """One row of totals, rates and distributions of a run. Rates are 0 where there is
    nothing to divide by."""
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    t = traces.agg(
        F.count_if(F.col("final_status") == "accepted").alias("accepted"),
        F.count_if(F.col("final_status") == "discarded").alias("discarded"),
        F.count_distinct("video_id").alias("videos"),
    )
    first = verdicts.where("round_index = 1").agg(F.count_if(F.col("decision") == "pass").alias("passed"), F.count(F.lit(1)).alias("judged"))
    one = total(segments, "segments").crossJoin(total(captions, "raw_captions")).crossJoin(total(events, "emotion_events")).crossJoin(total(queries, "initial_queries")).crossJoin(t).crossJoin(first)
    for name, df, column in (("emotions", events, "emotion_label"), ("initial_types", queries, "query_type"), ("accepted_types", traces.where("final_status = 'accepted'"), "query_type"), ("rewrites", traces, "rewrite_count")):
        one = one.crossJoin(as_map(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column).withColumnRenamed("counts", name))
    return one.select(
        "*",
        F.round(ratio(F.col("accepted"), F.col("videos")), 4).alias("accepted_per_video"),
        F.round(ratio(F.col("passed"), F.col("judged")), 4).alias("first_pass_rate"),
        F.round(ratio(F.col("accepted"), F.col("initial_queries")), 4).alias("acceptance_rate"),
    ).drop("passed", "judged")


def usage(calls: DataFrame, stage: str, measures: list[str]) -> DataFrame:
    """Sums by stage, and a total with a null stage, in one pass."""
    return calls.rollup(stage).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(m).alias(m) for m in measures])


def reground_counts(df: DataFrame) -> DataFrame:
    """(changed, fallback) over rows with old and new ids and whether the choice stood."""
    return df.agg(F.count_if(F.col("valid") & (F.col("new_ids") != F.col("old_ids"))).alias("changed"), F.count_if(~F.col("valid")).alias("fallback"))


def evaluation_summary(traces: DataFrame, rounds: DataFrame) -> DataFrame:
    """(part, value, n, pct): outcomes of queries and decisions of all rounds."""
    parts = [histogram(df, c).select(F.lit(c).alias("part"), F.col(c).alias("value"), "n", "pct") for df, c in ((traces, "final_status"), (rounds, "decision"))]
    return parts[0].unionByName(parts[1])


def dataset_summary(queries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: queries, verdicts that pass, their rate, and videos."""
    q = queries.agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("video_id").alias("videos"))
    v = verdicts.agg(F.count_if(F.col("decision") == "pass").alias("passed"), F.count(F.lit(1)).alias("judged"))
    return q.crossJoin(v).select("queries", "passed", F.round(ratio(F.col("passed"), F.col("judged")), 4).alias("pass_rate"), "videos")


def outcomes_by_video(traces: DataFrame) -> DataFrame:
    """(video_id, accepted, discarded)."""
    return traces.groupBy("video_id").agg(*[F.count_if(F.col("final_status") == s).alias(s) for s in ("accepted", "discarded")])


def warnings(messages: Column) -> Column:
    """The messages of an array that are warnings."""
    return F.filter(messages, lambda m: m.contains("WARNING"))
