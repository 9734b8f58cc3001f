"""Connected components by alternating large and small stars.

Every round is a few aggregations and joins on the links that are left; each is
written to the shared folder, so lineage stays short and a lost executor costs
one round.  Nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected(links: DataFrame, root: str) -> DataFrame:
    """(node, component) of each node in ``links`` (a, b), component the smallest
    reachable node. ``root`` is a scratch folder. No links: no rows."""
    spark = links.sparkSession
    links = common.settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{root}/links-0")
    before, step = None, 0
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before, step = tuple(state), step + 1
        starred = _small_star(_large_star(links).distinct()).where("a <> b").distinct()
        links = common.settle(starred, f"{root}/links-{step}")
        if step > 1:
            common.drop(spark, f"{root}/links-{step - 2}")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches by links a[i] - b[i]."""
    label = np.arange(n)  # between rounds the smallest index of each node's tree
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
