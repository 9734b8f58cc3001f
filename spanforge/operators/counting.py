"""Counters of a stage, taken while its rows are written: no second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Tally:
    """Counts of rows by condition, in the job that writes them.

    ``of`` puts the counters on a DataFrame; after its first action ``counts`` has them.
    A condition that is null does not count. Counters belong to one run of one plan: a
    DataFrame that is run twice counts the first time only, and a shuffle's map side
    that is run again after a lost executor may be counted again, so a stage puts its
    counters behind its last shuffle and right before it writes."""

    def __init__(self, **conditions: Column):
        if not conditions:
            raise ValueError("nothing to count")
        self.conditions = conditions
        self.observation = Observation()

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.observation, F.count(F.lit(1)).alias("__all"), *[F.count_if(c).alias(n) for n, c in self.conditions.items()])

    def counts(self) -> dict[str, int]:
        """``total`` and each counter; waits for the action."""
        found = dict(self.observation.get)
        return {"total": found.pop("__all"), **found}

    def table(self, spark: SparkSession) -> DataFrame:
        """(counter, n)."""
        return spark.createDataFrame(list(self.counts().items()), "counter string, n long")


def split(rows: DataFrame, keep: Column, **why: Column) -> tuple[DataFrame, Tally]:
    """Rows that ``keep``, and a tally of kept, dropped and each reason among the dropped."""
    good = F.coalesce(keep, F.lit(False))
    tally = Tally(kept=good, dropped=~good, **{n: ~good & F.coalesce(c, F.lit(False)) for n, c in why.items()})
    return tally.of(rows).where(good), tally
