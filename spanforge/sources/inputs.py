"""Inputs of single experiments: gold and predictions, cue checks, samples of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import rendered, says_yes
from . import records
from .model import Client, model_stage

_S = T.StringType()
_F = T.StructField
CUE = T.StructType([_F("query_id", _S), _F("label", _S), _F("cue", _S), _F("clips", T.ArrayType(_S))])


def _last_line(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines, of several lines of one key the last; a missing file is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    own = rows.select(*schema.names, place.alias("_place"))
    rest = [c for c in schema.names if c != key]
    return own.groupBy(key).agg(F.max_by(F.struct(*rest), "_place").alias("_r")).select(key, "_r.*").select(schema.names)


def grounding_inputs(spark: SparkSession, gold: str, predictions: str) -> DataFrame:
    """Gold rows with their prediction (``pred``, ``raw``), null where there is none: of
    several predictions of a query the last line counts, gold rows stay as they are."""
    told = _last_line(spark, predictions, records.PREDICTION, "query_id")
    return records.read_jsonl(spark, gold, records.GOLD, missing_ok=False).join(told, "query_id", "left")


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, label, cue, clips) of a cue test set; a list of cues is joined by '; '."""
    rows = records.read_jsonl(spark, path, CUE, missing_ok=False)
    listed = F.from_json("cue", "array<string>")
    return rows.withColumn("cue", F.when(F.col("cue").startswith("["), F.coalesce(F.array_join(listed, "; "), F.col("cue"))).otherwise(F.col("cue")))


def cue_stage(cues: DataFrame, client: Callable[[], Client], template: str) -> DataFrame:
    """(query_id, label, cue, flagged_hallucination, per_clip): each clip is asked for the cue
    ({cue}); a cue that no clip shows is flagged, and so is one without clips. A call that
    fails counts as no, its error as the reply."""
    from ..operators.stages import settled

    each = cues.select("query_id", "label", "cue", F.posexplode("clips").alias("pos", "clip"))
    work = each.withColumns({"key": F.concat_ws("\t", "query_id", "pos"), "prompt": rendered(template, cue=F.col("cue")), "media": F.array("clip")})
    said = work.join(settled(model_stage(work, client)), "key").withColumn("yes", F.coalesce(says_yes(F.col("raw")), F.lit(False)))
    one = F.struct("pos", F.regexp_extract("clip", r"([^/]*)$", 1).alias("clip"), F.when(F.col("yes"), "YES").otherwise("NO").alias("verdict"), F.left(F.coalesce("raw", "error"), F.lit(120)).alias("reply"))
    shape = "array<struct<clip:string,verdict:string,reply:string>>"
    found = said.groupBy("query_id").agg(F.bool_or("yes").alias("seen"), F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["clip"].alias("clip"), x["verdict"].alias("verdict"), x["reply"].alias("reply"))).alias("per_clip"))
    rows = cues.select("query_id", "label", "cue").join(found, "query_id", "left")
    return rows.select("query_id", "label", "cue", (~F.coalesce("seen", F.lit(False))).alias("flagged_hallucination"), F.coalesce("per_clip", F.array().cast(shape)).alias("per_clip"))


def sampled(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` files (path, video_id) by the order of a seeded hash of their id: the same files
    for the same seed whatever else is listed in what order. Not the draw of Python's
    generator: to repeat that, name the ids."""
    return files.orderBy(F.xxhash64(F.lit(seed), "video_id"), "video_id").limit(n)


def selection(files: DataFrame, n: int, path: str) -> DataFrame:
    """The first ``n`` files by id, written once to ``path`` and read from there ever after,
    so that a resumed run goes on with the same ones."""
    spark = files.sparkSession
    if not records.exists(spark, f"{path}/_SUCCESS"):
        files.orderBy("video_id").limit(n).write.mode("overwrite").json(path)
    return spark.read.schema(files.schema).json(path)
