"""Vector codes: each part of a vector as the number of a codebook entry.

Vectors become integers and are written as columnar blocks, a row of integers for each
component.  Each round adds up squared distances component by component over a block,
takes the nearest entries, and scatters integer sums and counts into one tensor a
partition (``np.add.at``); the tensors meet in a reduction tree (``treeAggregate``).
All arithmetic is on 64-bit integers, so the result does not depend on how rows are dealt.
What travels whole is the codebooks: ``size`` entries of one vector's length.

Defined results: vectors that are null or hold a null or a non-finite component are
dropped; shorter ones are filled up with zeros to the longest, and that to a multiple
of ``parts``; integers are held within the bound where all squared distances of a
vector still fit 64 bits (2^28 at 64 components); null vec_ids come last in the choice
of first entries and ties of vec_id by vector; fewer vectors than ``size`` give fewer
entries; repeated rows are rows of their own; ``label_error`` beyond 64 bits is null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_BLOCK_BYTES = 1 << 21


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the vectors without null or non-finite components."""
    v = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.col("v").isNotNull() & fine)


def bound(d: int) -> int:
    """Largest integer such that d squared differences add up within 64 bits."""
    return math.isqrt((2**63 - 1) // max(d, 1)) // 2


def as_integers(lists: pa.ListArray, d: int, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) as (d, rows), zeros after a vector's end."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros((d, len(size)), np.int64)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)
    most = float(bound(d))
    with np.errstate(over="ignore"):
        out[at, np.repeat(np.arange(len(size)), size)] = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
    return out


def _blocks(d: int, ids: pa.DataType, labels: pa.DataType):
    rows = max(1, _BLOCK_BYTES // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                block = as_integers(part.column("v"), d)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.tobytes()], pa.binary()), pa.ListArray.from_arrays(ends, part.column("vec_id")), pa.ListArray.from_arrays(ends, part.column("label"))],
                    schema=pa.schema([("block", pa.binary()), ("ids", pa.list_(ids)), ("labels", pa.list_(labels))]),
                )

    return run


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of ``block`` (width, rows) the nearest entry of ``book`` (entries,
    width), ties to the lower index, and its squared distance."""
    distance = np.zeros((len(book), block.shape[1]), np.int64)
    for j, values in enumerate(block):
        step = book[:, j, None] - values
        step *= step
        distance += step
    index = distance.argmin(axis=0)
    return index, distance[index, np.arange(block.shape[1])]


def _gathered(books):
    """(sums, counts) with one block added, for ``treeAggregate``."""

    def add(total, data: bytes):
        book = books.value
        parts, entries, width = book.shape
        block = np.frombuffer(data, np.int64).reshape(parts, width, -1)
        sums, counts = total if total is not None else (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
        for p in range(parts):
            index, _ = nearest(block[p], book[p])
            np.add.at(sums[p], index, block[p].T)
            np.add.at(counts[p], index, 1)
        return sums, counts

    return add


def _joined(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` of assigning and averaging;
    an entry that no part is nearest to stays."""
    context = blocks.sparkSession.sparkContext
    data = blocks.select("block").rdd.map(lambda row: bytes(row[0]))
    depth = 2 if data.getNumPartitions() <= 10_000 else 3
    for _ in range(rounds):
        sent = context.broadcast(books)
        sums, counts = data.treeAggregate(None, _gathered(sent), _joined, depth)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        sent.unpersist()
    return books


def _coded(books: np.ndarray, schema: pa.Schema):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = np.frombuffer(batch.column("block")[i].as_buffer(), np.int64).reshape(parts, width, -1)
                found = [nearest(block[p], books[p]) for p in range(parts)]
                codes = np.stack([index for index, _ in found], axis=1)
                error = sum(distance for _, distance in found)
                code = ["".join(f"{x:02x}" for x in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(code, pa.string()), common.longs(error)], schema=schema)

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each sound row of ``vectors``
    (vec_id, embedding, label)."""
    if not 0 < size <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = sound_vectors(vectors)
    kind = rows.schema["label"].dataType.simpleString()
    width = -(-max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    d = parts * width
    root = common.scratch(spark, "codes")
    ids, labels = pa.int64(), common.arrow_type(rows.schema["label"].dataType)
    made = rows.mapInArrow(_blocks(d, ids, labels), f"block binary, ids array<long>, labels array<{kind}>")
    blocks = common.settle(made, f"{root}/blocks")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).select("v").toArrow()
    result = f"vec_id long, label {kind}, code string, error long"
    if not first.num_rows:
        return spark.createDataFrame([], f"{result}, label_error long, codebooks_sha256 string").drop("label")
    entries = as_integers(first.column("v").combine_chunks(), d)
    books = trained(blocks, entries.reshape(parts, width, -1).transpose(0, 2, 1).copy(), rounds)
    schema = pa.schema([("vec_id", ids), ("label", labels), ("code", pa.string()), ("error", pa.int64())])
    coded = common.settle(blocks.mapInArrow(_coded(books, schema), result), f"{root}/coded")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
