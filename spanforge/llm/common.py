"""Helpers shared by the operators: scratch tables, document identity, Arrow."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session
    gets one of its own and any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder. It goes when Python ends, or by ``drop``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder (Hadoop file system, so any store works)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made[:] = [x for x in _made if x[1] != path]


class Scratch:
    """Scratch of steps that are written one after another: when a step begins, what the
    steps before it made goes, but for folders that its input is read from."""

    def __init__(self) -> None:
        self.left: list[str] = []

    def step(self, docs: DataFrame, work) -> DataFrame:
        read = docs.inputFiles() if self.left else []
        held = [p for p in self.left if any(p in f for f in read)]
        for path in self.left:
            if path not in held:
                drop(docs.sparkSession, path)
        before = {p for _, p in _made}
        out = work(docs)
        self.left = held + [p for _, p in _made if p not in before]
        return out


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_made):
        try:
            drop(spark, path)
        except Exception:  # its session has ended: the folder is the cluster's to clean
            continue


def settle(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Write a table and read it back: cuts lineage, survives lost executors."""
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


NO_ID = -(2**63)


def identified(docs: DataFrame) -> DataFrame:
    """(did, th, text): ``did`` is doc_id with null as the smallest long, ``th`` a
    64-bit hash of the text, which orders rows of one doc_id. Rows are told apart by
    ``numbered``, never by these."""
    text = text_of(docs)
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID).cast("long")).alias("did"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
    )


def numbered(docs: DataFrame, path: str, base: int = 0) -> DataFrame:
    """Written as (rid, row): each row as it is, whatever its columns are called, and
    its number, which is given once and so survives reruns of what follows."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select((F.monotonically_increasing_id() + F.lit(base).cast("long")).alias("rid"), row.alias("row"))
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def row_text() -> Column:
    """The text of a ``numbered`` row, '' for null."""
    return F.coalesce(F.col("row.text").cast("string"), F.lit(""))


def row_doc_id() -> Column:
    """doc_id of a ``numbered`` row, null as the smallest long."""
    return F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID).cast("long"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``limit`` bytes of text, one row at least."""
    offsets = np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(offsets)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def doc_id_back(column: str = "did") -> Column:
    """doc_id from ``did``."""
    return F.when(F.col(column) != F.lit(NO_ID).cast("long"), F.col(column))


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


class Rows:
    """Gathers columns and gives them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 1 << 24):
        self.schema, self.limit, self.size = schema, limit, 0
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values, size: int = 64) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.size += size

    def take(self, least: int | None = None) -> Iterator[pa.RecordBatch]:
        if self.columns[0] and self.size >= (self.limit if least is None else least):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
            self.columns, self.size = [[] for _ in self.schema], 0


def by_key(batches: Iterator[pa.RecordBatch], column: str = "key") -> Iterator[pa.Table]:
    """Regroup key-sorted batches into tables that hold only whole keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and (cut or held[-1].column(column)[-1].as_py() != keys[-1]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def arrow_type(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)


def merged_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges, touching ones joined."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]
