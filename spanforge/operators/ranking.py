"""First and last wins, caps, samples, chunks, resume joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _wins(df: DataFrame, keys: list[str], pos: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(pos)).alias("__r")).select(*keys, "__r.*")


def first_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The row of smallest ``pos`` per key; partial aggregation, no sort."""
    return _wins(df, keys, pos, F.min_by)


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return _wins(df, keys, pos, F.max_by)


def merged_runs(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of several runs; a later run's row replaces an earlier one's."""
    tagged = [r.withColumn("src", F.lit(i)) for i, r in enumerate(runs)]
    all_rows = tagged[0]
    for t in tagged[1:]:
        all_rows = all_rows.unionByName(t, allowMissingColumns=True)
    return last_wins(all_rows, keys, "src").drop("src")


def capped(df: DataFrame, group: str, order: list, n: int, status: str = "final_status") -> DataFrame:
    """Accepted rows beyond the first ``n`` of a group (in order) become discarded."""
    w = Window.partitionBy(group, status).orderBy(*order)
    over = (F.col(status) == "accepted") & (F.row_number().over(w) > n)
    return df.withColumn(status, F.when(over, "discarded").otherwise(F.col(status)))


def head_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def round_robin(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """``n`` rows, one from each group in turn; the sample is the feature's limit."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("rn", group).limit(n)


def chunked(df: DataFrame, group: str, order: list, size: int, name: str = "chunk") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn(name, F.floor(n / size).cast("long"))


def consecutive(index: str) -> Column:
    """Aggregate: whether the indices of a group are a run without holes."""
    return F.max(index) - F.min(index) + 1 == F.count_distinct(index)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def needed(items: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(wanted.select(*keys), keys, "left_semi")


def cache_split(work: DataFrame, cache: DataFrame, keys: list[str], valid: str) -> tuple[DataFrame, DataFrame]:
    """(hits, to do): a cached row counts only if ``valid`` holds."""
    good = cache.where(F.col(valid))
    return needed(cache, work, keys).where(F.col(valid)), pending(work, good, keys)


def with_missing(verdicts: DataFrame, asked: DataFrame, keys: list[str], **defaults) -> DataFrame:
    """Verdicts, and a row of literals for each key that was asked and not answered."""
    lost = pending(asked.select(*keys).distinct(), verdicts, keys)
    return verdicts.unionByName(lost.select(*keys, *[F.lit(v).alias(k) for k, v in defaults.items()]), allowMissingColumns=True)


def looked_up(items: DataFrame, keys: list[str], array: str, dimension: DataFrame, id_column: str, value: str, n: int | None = None) -> DataFrame:
    """Values of an array column's ids, in order, unknown ids left out, at most ``n``."""
    rows = items.select(*keys, F.posexplode_outer(array).alias("pos", id_column))
    joined = rows.join(dimension.select(*[k for k in keys if k in dimension.columns], id_column, value), [*[k for k in keys if k in dimension.columns], id_column], "left")
    found = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("pos", value))))
    values = F.transform(found, lambda x: x[value])
    return joined.groupBy(*keys).agg((F.slice(values, 1, n) if n else values).alias(value + "s"))
