"""Runs as a whole: a store by video, and the folders that one stage leaves to the next."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog, records

_S = T.StringType()


class VideoStore:
    """Tables of a run that take in later runs video by video.

    ``replace`` takes over whole videos: a video that the new rows of a table hold loses
    all its old rows of that table, others keep theirs. It writes the new rows as one more
    part, a folder of files whatever the number of videos; ``table`` takes each video from
    the last part that holds it. A part counts once the table's list names it, and the list
    is put in place in one step: a stop before that leaves the table as it was, and the call
    may be repeated. After ``most`` parts the table is written anew as one, without the rows
    that were replaced; all else in its folder goes. A table that an earlier version wrote,
    with a folder a video, is taken as its first part. One writer at a time is assumed.
    """

    OLD = "video_id=*"

    def __init__(self, spark: SparkSession, folder: str, most: int = 8):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most

    def _parts(self, name: str) -> list[str]:
        """The names of the parts that count, the oldest first."""
        path = f"{self.folder}/{name}/parts.json"
        if records.exists(self.spark, path):
            return catalog.read_document(self.spark, path)["parts"]
        return [self.OLD] if records.listed(self.spark, f"{self.folder}/{name}/{self.OLD}") else []

    def _add(self, name: str, rows: DataFrame, before: list[str]) -> list[str]:
        part = f"part-{uuid.uuid4().hex}"
        # in order within a file, so that one video is read from few of its pages
        rows.sortWithinPartitions("video_id").write.parquet(f"{self.folder}/{name}/{part}")
        catalog.write_document(self.spark, f"{self.folder}/{name}/parts.json", {"parts": [*before, part]})
        return [*before, part]

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Rows without a video are an error, as nothing could replace them."""
        own = F.when(F.length("video_id") > 0, F.col("video_id")).otherwise(F.raise_error(F.lit("a row without a video")).cast("string"))
        for name, df in tables.items():
            rows = catalog.conformed(catalog.final_rows(df) if name == "final" else df, catalog.SCHEMAS[name])
            parts = self._add(name, rows.withColumn("video_id", own), self._parts(name))
            if len(parts) > self.most:
                whole = self._add(name, self.table(name), [])
                gone = [p for p in records.listed(self.spark, f"{self.folder}/{name}/*") if p.rsplit("/", 1)[1] not in ("parts.json", *whole)]
                records.drop(self.spark, gone)

    def table(self, name: str) -> DataFrame:
        """A table in its declared order of columns, empty if nothing was ever written."""
        schema = catalog.SCHEMAS[name]
        base = f"{self.folder}/{name}"
        parts = [self.spark.read.schema(schema).option("basePath", base).parquet(f"{base}/{p}").select(schema.names) for p in self._parts(name)]
        return catalog.latest(parts) if parts else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in catalog.FILES}


def either(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines in a folder, or one document in a file of any layout."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(p):
        return spark.createDataFrame([], schema)
    one = system.getFileStatus(p).isFile()
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", one).json(path)


def _documents(spark: SparkSession, folder: str, values: dict[str, dict]) -> None:
    for name, value in values.items():
        catalog.write_document(spark, f"{folder}/{name}", value)


def save_captions(folder: str, raw: DataFrame, captions: DataFrame, segments: DataFrame, metadata: dict) -> None:
    """Stage 1: raw replies, captions, segments, metadata."""
    records.write_jsonl(raw, f"{folder}/raw_caption_output.json")
    records.write_jsonl(catalog.conformed(captions, records.CAPTION), f"{folder}/normalized_captions.jsonl")
    records.write_jsonl(catalog.conformed(segments, records.SEGMENT), f"{folder}/segments.jsonl")
    _documents(segments.sparkSession, folder, {"run_metadata.json": metadata})


def load_captions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(segments, captions) of stage 1."""
    return records.read_jsonl(spark, f"{folder}/segments.jsonl", records.SEGMENT), records.read_jsonl(spark, f"{folder}/normalized_captions.jsonl", records.CAPTION)


def save_generation(folder: str, events: DataFrame, queries: DataFrame, segments: DataFrame, metadata: dict) -> None:
    """Stage 2: events and queries nested by video (a video without any keeps its row),
    segments passed on, metadata."""
    records.write_jsonl(catalog.nested(catalog.conformed(events, records.EVENT), "events", ["event_id"], segments), f"{folder}/emotion_events.json")
    records.write_jsonl(catalog.nested(catalog.conformed(queries, records.QUERY), "queries", ["query_id"], segments), f"{folder}/generated_queries.json")
    records.write_jsonl(catalog.conformed(segments, records.SEGMENT), f"{folder}/segments.jsonl")
    _documents(segments.sparkSession, folder, {"generation_metadata.json": metadata})


def load_generation(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """segments, events and queries of stage 2, also where a stage left one document."""
    out = {"segments": records.read_jsonl(spark, f"{folder}/segments.jsonl", records.SEGMENT)}
    for name, file, schema in (("events", "emotion_events.json", records.EVENT), ("queries", "generated_queries.json", records.QUERY)):
        shape = T.StructType([T.StructField("video_id", _S), T.StructField(name, T.ArrayType(schema))])
        out[name] = catalog.unnested(either(spark, f"{folder}/{file}", shape), name)
    return out


def save_evaluation(folder: str, final: DataFrame, summary: dict, metadata: dict) -> None:
    """Stage 3: final queries, the summary of their verdicts, metadata."""
    records.write_jsonl(catalog.final_rows(final), f"{folder}/final_queries.json")
    _documents(final.sparkSession, folder, {"verification_summary.json": summary, "evaluation_metadata.json": metadata})


def load_evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(final queries, summary) of stage 3; the queries may be one document's array."""
    return either(spark, f"{folder}/final_queries.json", catalog.FINAL), catalog.read_document(spark, f"{folder}/verification_summary.json")


def document_of(row: DataFrame) -> dict:
    """The one row of a statistics table as a document; maps and nulls stay."""
    found = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()
    if found is None:
        raise ValueError("no row to make a document of")
    return json.loads(found[0])


# The fields of a run's statistics.
STATS_FIELDS = {
    "total_videos": "videos", "total_segments": "segments", "total_raw_captions": "raw_captions", "total_emotion_events": "emotion_events", "total_initial_queries": "initial_queries",
    "total_accepted_queries": "accepted", "total_discarded_queries": "discarded", "average_accepted_queries_per_video": "accepted_per_video",
    "emotion_distribution": "emotions", "query_type_distribution_initial": "initial_types", "query_type_distribution_final_accepted": "accepted_types", "rewrite_count_distribution": "rewrites",
    "pass_rate_after_initial_verification": "first_pass_rate", "pass_rate_after_rewrites": "acceptance_rate", "discarded_query_count": "discarded",
}


def stats_document(run_stats: DataFrame, warnings: list[str] = (), changed: int = 0, fallback: int = 0) -> dict:
    """``stats.run_stats`` under the names of a run's statistics file; of the messages
    those that are warnings."""
    row = document_of(run_stats)
    out = {name: row.get(column) for name, column in STATS_FIELDS.items()}
    return out | {"diversity_warnings": [w for w in warnings if "WARNING" in w], "regrounding_changed_count": changed, "regrounding_fallback_count": fallback}


def run_metadata(model: str, kind: str, segments: DataFrame, captions: DataFrame, by_video: DataFrame, seconds: float, **settings) -> dict:
    """The metadata of a caption run. ``by_video`` (video_id, num_cached, seconds) has a row
    a video, as the file lists them; counts come from the tables."""
    counts = {name: df.count() for name, df in (("num_segments", segments), ("num_captions", captions))}
    sizes = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_segments"))
    per_video = by_video.join(sizes, "video_id", "left").select("video_id", F.coalesce("num_segments", F.lit(0)).alias("num_segments"), "num_cached", F.round("seconds", 1).alias("seconds")).orderBy("video_id")
    rows = [r.asDict() for r in per_video.toLocalIterator()]
    return {"caption_model": model, "model_kind": kind, "num_videos": len(rows), **counts, "total_seconds": round(seconds, 1), "per_video": rows, **settings}
