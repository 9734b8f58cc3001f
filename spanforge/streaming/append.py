"""Append as you go: a stream over a table of work, with results that survive a stop.

Each micro-batch asks for the keys that no earlier batch has answered and writes its
answers as a partition of its own, ``batch=<id>``.  A batch that is run again after a
stop overwrites that partition, so results hold each key once, whatever was done when.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import records


def answered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows answered so far with the ``batch`` that answered them."""
    schema = T.StructType([*schema, T.StructField("batch", T.LongType())])
    if not records.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_as_you_go(work: DataFrame, answer: Callable[[DataFrame], DataFrame], schema: T.StructType, key: list[str], path: str, checkpoint: str) -> None:
    """Run ``answer`` (rows with ``key`` -> rows of ``schema``, which holds ``key``) over a
    stream until nothing is left. The first of several rows of one key counts, in
    whatever batch it comes; a key without an answer is asked again by the next stream."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = answered(spark, path, schema).where(F.col("batch") != number).select(*key)
        fresh = rows.dropDuplicates(key).join(done, key, "left_anti")
        out = answer(fresh).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        out.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={number}")

    work.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
