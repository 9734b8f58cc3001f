"""Typed record files: JSON lines, nested documents, CSV, keyed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _A = T.StringType(), T.DoubleType(), T.IntegerType(), T.ArrayType
_F = T.StructField
SEGMENT = T.StructType([_F("video_id", _S), _F("segment_id", _S), _F("index", _I), _F("start_time", _D), _F("end_time", _D), _F("clip_path", _S)])
CAPTION = T.StructType([_F("video_id", _S), _F("segment_id", _S), _F("time_range", _A(_D)), _F("visual_description", _S), _F("audio_description", _S), _F("confidence", _S), _F("evidence_strength", _S)])
EVENT = T.StructType([_F("video_id", _S), _F("event_id", _S), _F("emotion_label", _S), _F("event_description", _S), _F("time_range", _A(_D)), _F("target_person_or_group", _S), _F("visual_evidence", _A(_S)), _F("audio_evidence", _A(_S)), _F("confidence", _S), _F("evidence_strength", _S), _F("segment_ids", _A(_S))])
EVIDENCE = T.StructType([_F("visual_evidence", _A(_S)), _F("audio_evidence", _A(_S))])
QUERY = T.StructType([_F("video_id", _S), _F("query_id", _S), _F("query_type", _S), _F("query_text", _S), _F("grounding_event_description", _S), _F("target_person_or_group", _S), _F("expected_evidence", _A(_S)), _F("why_grounded", _S), _F("time_range", _A(_D)), _F("segment_ids", _A(_S)), _F("source_caption_ids", _A(_S)), _F("gen_time_range", _A(_D)), _F("gen_segment_ids", _A(_S)), _F("approximate_grounding_time", _S), _F("grounding_evidence", EVIDENCE)])
VERDICT = T.StructType([_F("video_id", _S), _F("query_id", _S), _F("round_index", _I), _F("decision", _S), _F("emotion_relevance_pass", T.BooleanType()), _F("answerability_pass", T.BooleanType()), _F("query_quality_pass", T.BooleanType()), _F("failure_reason", _S), _F("suggested_revision", _S)])
GOLD = T.StructType([_F("query_id", _S), _F("video_id", _S), _F("duration", _D), _F("query_text", _S), _F("query_type", _S), _F("gold_ranges", _A(_A(_D)))])
PREDICTION = T.StructType([_F("query_id", _S), _F("pred", _A(_D)), _F("raw", _S)])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern meets, none if there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(f.getPath().toString()) for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []]


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = True) -> DataFrame:
    """JSON lines of a declared schema. Blank lines are skipped, a malformed line
    fails the read, a missing file is an empty table unless ``missing_ok`` is off."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_nested(spark: SparkSession, path: str, schema: T.StructType, field: str) -> DataFrame:
    """The rows of an array in one JSON document."""
    doc = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(T.StructType([_F(field, _A(schema))])).json(path)
    return doc.select(F.inline(field))


def read_queries_by_video(spark: SparkSession, path: str) -> DataFrame:
    """Lines (video_id, queries[]); the last line of a video wins."""
    lines = spark.read.schema(T.StructType([_F("video_id", _S), _F("queries", _A(QUERY))])).option("mode", "FAILFAST").json(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = lines.select("video_id", "queries", place.alias("place"))
    last = lines.groupBy("video_id").agg(F.max_by("queries", "place").alias("queries"))
    each = last.select(F.col("video_id").alias("_video"), F.inline("queries"))
    return each.withColumn("video_id", F.coalesce("video_id", "_video")).drop("_video")


def repaired(segments: DataFrame, known: list[str]) -> DataFrame:
    """``video_id`` as given, else the one component of the clip path that is a known
    video; rows with none or several go."""
    found = F.array_intersect(F.split("clip_path", "/"), F.array(*map(F.lit, known)).cast("array<string>"))
    return segments.withColumn("video_id", F.coalesce("video_id", F.when(F.size(found) == 1, found[0]))).where("video_id is not null")


def video_in_path(path, folder: str = "processed_segments"):
    return F.regexp_extract(path, rf"{folder}/([^/]+)/", 1)


def label_of(path):
    """Run label from a results path: its folder, less a leading ``verify_``."""
    return F.regexp_extract(path, r"(?:^|/)(?:verify_)?([^/]+)/[^/]*$", 1)


def list_files(spark: SparkSession, folder: str, extensions=("mp4", "mkv", "mov", "avi", "webm")) -> DataFrame:
    """(path, video_id): files by extension, keyed by their stem; contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    pattern = rf"(?i)([^/]+)\.({'|'.join(extensions)})$"
    return files.where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).alias("video_id"))


def pick(files: DataFrame, ids: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Files of the given ids in the caller's order (missing ids raise), or the first
    ``n`` by id."""
    if ids is None:
        return files.orderBy("video_id").limit(n) if n else files.orderBy("video_id")
    wanted = files.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, video_id string")
    lost = [r[0] for r in wanted.join(files, "video_id", "left_anti").select("video_id").collect()]
    if lost:
        raise FileNotFoundError(f"no video for {', '.join(sorted(lost))}")
    return files.join(wanted, "video_id").orderBy("pos").drop("pos")


def cache_state(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``reason``: not_found, json_parse_error, missing_required_fields,
    schema_validation_error, or null for a caption that can be used."""
    from ..functions import schema

    return rows.withColumn("reason", schema.checked(F.col(raw), schema.CAPTION)["reason"])


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode(mode).json(path)


def nested_by_video(queries: DataFrame, videos: DataFrame, *by: str) -> DataFrame:
    """(video_id, [by,] queries[]); videos without any keep a row."""
    g = queries.groupBy("video_id", *by).agg(F.sort_array(F.collect_list(F.struct("query_id", *[c for c in queries.columns if c not in ("video_id", "query_id", *by)]))).alias("queries"))
    return videos.select("video_id").distinct().join(g, "video_id", "left").withColumn("queries", F.coalesce("queries", F.array()))


def review_sheet(traces: DataFrame) -> DataFrame:
    """Accepted queries by video and id, with empty columns for a reviewer."""
    from ..functions.text import time_label

    kept = traces.where("final_status = 'accepted'").select("video_id", "query_id", "query_type", F.col("final_query_text").alias("final_query"), time_label(F.col("time_range")).alias("time_range"))
    # The columns that a reviewer fills in.
    return kept.select("*", *[F.lit("").alias(c) for c in ("human_decision", "revised_query", "human_notes")]).orderBy("video_id", "query_id")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_run(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of a run as JSON lines under its name."""
    for name, df in tables.items():
        write_jsonl(df, f"{folder}/{name}")


def dead_letters(df: DataFrame, path: str) -> None:
    """Append replies that could not be used, with their reason."""
    df.where("error is not null").select("key", F.col("error").alias("reason"), "raw").write.mode("append").parquet(path)
