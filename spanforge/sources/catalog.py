"""A run's tables on disk: export, reload, merge, caches and single documents."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import records

_F = T.StructField
ROUNDS = T.ArrayType(T.StructType([_F("round_index", T.IntegerType()), _F("decision", T.StringType()), _F("failure_reason", T.StringType())]))
REWRITE = T.StructType([_F("video_id", T.StringType()), _F("round_index", T.IntegerType()), _F("rewrites", T.ArrayType(T.StructType([_F(c, T.StringType()) for c in ("query_id", "original_query_text", "rewritten_query_text", "query_type", "rewrite_reason")])))])
FINAL = T.StructType(
    [_F(c, T.StringType()) for c in ("video_id", "query_id", "query_type", "initial_query_text", "final_query_text", "grounding_event_description", "target_person_or_group")]
    + [_F("approximate_grounding_time", T.StringType()), _F("expected_evidence", T.ArrayType(T.StringType())), _F("grounding_evidence", records.EVIDENCE)]
    + [_F("time_range", T.ArrayType(T.DoubleType())), _F("segment_ids", T.ArrayType(T.StringType())), _F("source_caption_ids", T.ArrayType(T.StringType())), _F("gen_time_range", T.ArrayType(T.DoubleType())), _F("gen_segment_ids", T.ArrayType(T.StringType()))]
    + [_F("rewrite_count", T.IntegerType()), _F("verification_rounds", ROUNDS), _F("final_status", T.StringType())]
)
# Names of a run's files.
FILES = {
    "segments": "segments.jsonl",
    "captions": "raw_captions.jsonl",
    "events": "emotion_events.jsonl",
    "queries": "initial_queries.jsonl",
    "verdicts": "verification_rounds.jsonl",
    "rewrites": "rewritten_queries.jsonl",
    "final": "final_queries.jsonl",
}
SCHEMAS = {"segments": records.SEGMENT, "captions": records.CAPTION, "events": records.EVENT, "queries": records.QUERY, "verdicts": records.VERDICT, "rewrites": REWRITE, "final": FINAL}


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, cast; those that are missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def check_columns(tables: dict[str, DataFrame], needed: dict[str, list[str]]) -> None:
    """Raise if a stage's input lacks a table or a column."""
    for name, columns in needed.items():
        if name not in tables:
            raise TypeError(f"no table {name}")
        if lost := [c for c in columns if c not in tables[name].columns]:
            raise TypeError(f"{name} lacks {', '.join(lost)}")


def with_video(rows: DataFrame, video_id: str) -> DataFrame:
    """Rows of one video with its id, where they have none."""
    own = F.col("video_id") if "video_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("video_id", F.coalesce(own, F.lit(video_id)))


def flat_events(outputs: DataFrame) -> DataFrame:
    """(video_id, events[]) -> one row an event."""
    return outputs.select(F.inline("events"))


def rewrites_by_round(rewrites: DataFrame) -> DataFrame:
    """One row for each video and round that has rewrites, in the order of their ids."""
    fields = [f.name for f in REWRITE["rewrites"].dataType.elementType]
    return rewrites.groupBy("video_id", "round_index").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rewrites"))


def nested(rows: DataFrame, field: str, order: list[str], videos: DataFrame | None = None, *by: str) -> DataFrame:
    """(video_id, [by,] field[]): the rows of each video in order; with ``videos`` those
    that have none keep a row."""
    rest = [c for c in rows.columns if c not in order]
    packed = F.sort_array(F.collect_list(F.struct(*order, F.struct(*rest).alias("_rest"))))
    back = F.transform(packed, lambda x: F.struct(*[(x[c] if c in order else x["_rest"][c]).alias(c) for c in rows.columns]))
    g = rows.groupBy("video_id", *by).agg(back.alias(field))
    if videos is None:
        return g
    every = videos.select("video_id").distinct().join(g, "video_id", "full")
    return every.withColumn(field, F.coalesce(field, F.array().cast(g.schema[field].dataType)))


def unnested(rows: DataFrame, field: str) -> DataFrame:
    """The rows of ``nested``, with the video of their line where they lack their own."""
    each = rows.select(F.col("video_id").alias("_video"), F.inline(field))
    return each.withColumn("video_id", F.coalesce("video_id", "_video")).drop("_video")


def final_rows(traces: DataFrame) -> DataFrame:
    """The final projection of all traces, discarded ones too."""
    names = {"initial_text": "initial_query_text", "text": "final_query_text", "rounds": "verification_rounds"}
    return conformed(traces.withColumnsRenamed({a: b for a, b in names.items() if a in traces.columns and b not in traces.columns}), FINAL)


def traces_of(final: DataFrame) -> DataFrame:
    """Traces from final rows, without what a trace does not take back (time range,
    grounding evidence, sources, generated span); an empty final text falls back to the
    initial one."""
    none = ("time_range", "grounding_evidence", "source_caption_ids", "gen_time_range", "gen_segment_ids")
    lost = [F.lit(None).cast(FINAL[c].dataType).alias(c) for c in none]
    text = F.coalesce(F.when(F.length("final_query_text") > 0, F.col("final_query_text")), F.col("initial_query_text"))
    kept = [c for c in final.columns if c not in none]
    return final.select(*kept, *lost, text.alias("current_query_text"))


#: Tables kept nested: field, order within it, and what beside the video makes a line.
NESTED = {"queries": ("queries", ["query_id"], ()), "verdicts": ("results", ["query_id"], ("round_index",))}


def write_run(tables: dict[str, DataFrame], folder: str, statistics: dict | None = None, prompts: dict[str, str] | None = None) -> None:
    """Each table as JSON lines under its name, queries nested by video (a video of the
    segments without any keeps a line) and verdicts by video and round; the review
    sheet, statistics and prompts (file name to text) with their versions beside them."""
    for name, df in tables.items():
        if name == "rewrites":
            rows = conformed(rewrites_by_round(df) if "rewrites" not in df.columns else df, REWRITE)
        elif name in NESTED:
            field, order, by = NESTED[name]
            rows = nested(conformed(df, SCHEMAS[name]), field, order, tables.get("segments") if name == "queries" else None, *by)
        else:
            rows = conformed(final_rows(df) if name == "final" else df, SCHEMAS[name])
        records.write_jsonl(rows, f"{folder}/{FILES[name]}")
    if "final" in tables:
        records.write_csv(records.review_sheet(final_rows(tables["final"])), f"{folder}/human_review_sheet.csv")
    spark = next(iter(tables.values())).sparkSession
    if statistics is not None:
        write_document(spark, f"{folder}/pipeline_stats.json", statistics)
    if prompts is not None:
        from .prompts import version

        for file, text in prompts.items():
            write_text(spark, f"{folder}/prompts_used/{file}", text)
        write_document(spark, f"{folder}/prompts_used/prompts_manifest.json", {file: version(text) or file for file, text in prompts.items()})


def read_run(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a run, typed and flat; a table that was not written is empty. Of several
    lines of one video's queries the last stands."""
    out = {}
    for n in names or FILES:
        path = f"{folder}/{FILES[n]}"
        if n == "queries":
            out[n] = records.read_queries_by_video(spark, path) if records.exists(spark, path) else spark.createDataFrame([], records.QUERY)
        elif n in NESTED:
            field, _, by = NESTED[n]
            lines = T.StructType([_F("video_id", T.StringType()), *[_F(c, T.IntegerType()) for c in by], _F(field, T.ArrayType(SCHEMAS[n]))])
            out[n] = unnested(records.read_jsonl(spark, path, lines), field)
        else:
            out[n] = records.read_jsonl(spark, path, SCHEMAS[n])
    return out


def latest(tables: list[DataFrame]) -> DataFrame:
    """One table of several, the oldest first: each video's rows in the last that holds it."""
    if len(tables) == 1:
        return tables[0]
    rows = None
    for k, own in enumerate(tables):
        own = own.withColumn("_run", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    last = rows.groupBy(F.col("video_id").alias("_video")).agg(F.max("_run").alias("_last"))
    return rows.join(last, F.col("video_id").eqNullSafe(F.col("_video")) & (F.col("_run") == F.col("_last")), "left_semi").drop("_run")


def merged_runs(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """One table of several runs. The last run that holds a video has all its rows: what
    that run no longer has is gone."""
    return latest([read_run(spark, folder, name)[name] for folder in folders])


def merged(spark: SparkSession, folders: list[str], into: str) -> dict[str, DataFrame]:
    """All tables of several runs, merged video by video and written as one run."""
    tables = {n: merged_runs(spark, folders, n) for n in FILES}
    write_run(tables, into)
    return read_run(spark, into)


def scan_models(spark: SparkSession, folders: dict[str, str], name: str) -> DataFrame:
    """A table of several models' runs with a ``model`` column."""
    rows = None
    for model, folder in sorted(folders.items()):
        own = read_run(spark, folder, name)[name].withColumn("model", F.lit(model))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def cache_path(root: str, model: Column, video: Column, segment: Column, kind: str = "json") -> Column:
    """Where a caption is cached: one file a segment, by model and video."""
    return F.concat_ws("/", F.lit(root), model, video, F.concat(segment, F.lit(f".{kind}")))


def clip_map(rows: DataFrame, order: str) -> DataFrame:
    """(video_id, segment_id, clip_path): the last path given for a segment."""
    return rows.where("clip_path is not null").groupBy("video_id", "segment_id").agg(F.max_by("clip_path", order).alias("clip_path"))


def event_clips(events: DataFrame, clips: DataFrame) -> DataFrame:
    """(video_id, event_id, clip_paths): clips of an event's segments, in their order."""
    each = events.select("video_id", "event_id", F.posexplode_outer("segment_ids").alias("pos", "segment_id")).join(clips, ["video_id", "segment_id"], "left")
    found = F.sort_array(F.collect_list(F.when(F.col("clip_path").isNotNull(), F.struct("pos", "clip_path"))))
    return each.groupBy("video_id", "event_id").agg(F.transform(found, lambda x: x["clip_path"]).alias("clip_paths"))


def file_of(listing: DataFrame, ids: DataFrame, extensions=("mp4", "mkv", "mov", "avi", "webm")) -> DataFrame:
    """(video_id, path) for each id, by the first extension that has a file; else null."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, extensions)), kind)
    best = listing.where(rank > 0).groupBy("video_id").agg(F.min_by("path", F.struct(rank.alias("r"), F.col("path"))).alias("path"))
    return ids.select("video_id").distinct().join(best, "video_id", "left")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, written beside its place and renamed over it in one step: a reader sees
    the old or the new one, never a part and never neither."""
    fs = spark._jvm.org.apache.hadoop.fs
    target, part = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    system = target.getFileSystem(conf)
    out = system.create(part, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(part), system.makeQualified(target), how)
    except BaseException:
        system.delete(part, False)
        raise


def write_document(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document (statistics, usage, metadata), replaced in one step."""
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False))


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def append_results(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the results lack: a stopped run goes on where it was."""
    spark = df.sparkSession
    if records.exists(spark, path):
        df = df.join(spark.read.schema(df.schema).json(path).select(*key), key, "left_anti")
    df.write.mode("append").json(path)


class StageTimes:
    """Wall time by stage and video, as rows for ``stats.usage``."""

    def __init__(self, clock=time.perf_counter):
        self.rows: list[tuple[str, str, float]] = []
        self.clock = clock

    @contextmanager
    def stage(self, video_id: str, stage: str):
        began = self.clock()
        try:
            yield
        finally:
            self.rows.append((video_id, stage, self.clock() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "video_id string, stage string, seconds double")
