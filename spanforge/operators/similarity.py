"""Nearest vectors of a stated set of queries, against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors of ``width`` components, zeros behind a shorter one's end. They are
    scaled by their largest component first, so no square overflows or vanishes."""
    lists = column.combine_chunks()
    size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    x = np.zeros((len(lists), width))
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    x[np.repeat(np.arange(len(size)), size), at] = lists.flatten().to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(k: int):
    """One block of queries and one of rows -> the k best rows of each query."""

    def run(group: pa.Table) -> pa.Table:
        asked = group.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("id").to_numpy()
        out: list[list] = [[], [], []]
        if asked.any() and not asked.all():
            v = group.column("v")
            width = pc.max(pc.list_value_length(v)).as_py()
            near = np.round(_matrix(v.filter(pa.array(asked)), width) @ _matrix(v.filter(pa.array(~asked)), width).T, 9)
            own, others = ids[asked], ids[~asked]
            for q, s in zip(own.tolist(), near, strict=True):
                some = np.flatnonzero(others != q)
                if len(some) > k:  # ties at the k-th place stay
                    some = some[s[some] >= np.partition(s[some], len(some) - k)[len(some) - k]]
                some = some[np.lexsort((others[some], -s[some]))][:k]
                out[0] += [q] * len(some)
                out[1] += others[some].tolist()
                out[2] += s[some].tolist()
        return pa.table({"query": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "s": pa.array(out[2], pa.float64())})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 1024, part: int = 16_384) -> DataFrame:
    """(query, id, s, rk) over (id long, v array<double>): the ``k`` rows of greatest cosine
    (to nine decimals, ties by id) for each query, itself excepted.  Each pair of a block of
    queries and a part of the rows is one group of bounded size; nothing is broadcast.
    Vectors that are null, zero or hold a null or a non-finite component are left out; a
    shorter one counts as filled up with zeros."""
    finite = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    sound = lambda df: df.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda e: e != 0), F.lit(False)))
    queries, rows = sound(queries), sound(rows)
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((queries, block), (rows, part)))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("id", "v", slot(blocks).alias("b")).select("*", each(parts).alias("p"), F.lit(True).alias("asked"))
    given = rows.select("id", "v", slot(parts).alias("p")).select("*", each(blocks).alias("b"), F.lit(False).alias("asked"))
    found = asked.unionByName(given).groupBy("b", "p").applyInArrow(_best(k), "query long, id long, s double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "id")).cast("long")
    return found.withColumn("rk", rank).where(F.col("rk") <= k)
