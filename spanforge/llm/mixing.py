"""Mixing sources to target weights: a time-varying curriculum.

Targets: sources in code point order (null last) have weights 3, 1, 2, repeating,
and share 150 % of all words; a source's target stops at twice its words and the
excess is shared again by weight (water filling, solved in closed form: sources
sorted by the level at which they are full).

Curriculum: a source's weight changes linearly over training time t from 0 to 1,
``w (1 + r (1 - 2 t))`` with its ramp ``r``; integrated, its demand up to t is
``target (t + r (t - t^2))``.  Documents of a source stand in an order drawn from
their ids; the words before a document are inverted through the demand to the
training time at which it is read, and rows are range-sorted by that position.
A source is read from its start again until its target is met; the document at
the end is taken in part, so that each source meets its target to the word.

The order within a source is cut into ranges of the id's hash, whose sums are
added up first: no task ever sorts a whole source.

Defined results: a null or empty text has size 0 and is never taken; a null source
is a source of its own, the last; a null doc_id hashes as ''; repeated rows are
rows of their own; an empty table gives an empty result; other columns are
ignored.  Runs agree, as nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, RAMPS = (3, 1, 2), (0.5, 0.0, -0.5)
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """(did, th, source, size, h, more): size in words, h a hash of the id as text."""
    text = common.text_of(docs)
    return docs.select(
        *more,
        F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NO_ID).cast("long")).alias("did"),
        F.xxhash64(text).alias("th"),
        docs["source"].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).alias("h"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, ramp): one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1).alias("place")
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", place)
    k = F.col("place") % len(weights) + 1
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), k).cast("double"))
    t = t.withColumn("ramp", F.element_at(F.array(*map(F.lit, ramps)), F.col("place") % len(ramps) + 1).cast("double"))
    t = t.withColumn("full", F.lit(most) * F.col("source_size")).withColumn("level", F.col("full") / F.col("weight"))
    order = Window.orderBy("level", "place")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("at", (budget - before) / weight_left)
    water = F.max(F.when(F.col("level") > F.col("at"), F.col("at"))).over(Window.partitionBy())
    t = t.withColumn("water", water)
    target = F.when(F.col("level") > F.col("at"), F.col("water") * F.col("weight")).otherwise(F.col("full"))
    return t.select("source", "source_size", target.alias("target"), "ramp")


def training_time(words: Column, target: Column, ramp: Column) -> Column:
    """The time at which a source's demand reaches ``words``."""
    x = words / target
    root = F.sqrt((1 + ramp) * (1 + ramp) - 4 * ramp * x)
    return F.when(ramp == 0, x).otherwise((1 + ramp - root) / (2 * F.nullif(ramp, F.lit(0.0))))


def mix(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = 1.5, most: float = 2.0, digits: int = 3) -> DataFrame:
    """(did, th, source, size, source_size, target, taken, before, ramp): the words
    the mix takes of each row. ``digits`` is how many hex digits of the hash cut a
    source's order into ranges. See the module for its rules."""
    return _mixed(sizes(docs), common.scratch(docs.sparkSession, "mixing"), weights, ramps, share, most, digits)


def _mixed(sized: DataFrame, root: str, weights=WEIGHTS, ramps=RAMPS, share: float = 1.5, most: float = 2.0, digits: int = 3) -> DataFrame:
    more = [c for c in sized.columns if c not in ("did", "th", "source", "size", "h")]
    sized = common.settle(sized.withColumn("cut", F.substring("h", 1, digits)), f"{root}/sizes")
    sums = sized.groupBy("source", "cut").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.select(F.col("source").alias("s"), F.col("cut").alias("c"), ahead.alias("ahead"))
    plan = targets(sized, weights, ramps, share, most).withColumnRenamed("source", "s2")
    ranges = ranges.join(plan, ranges["s"].eqNullSafe(plan["s2"])).drop("s2")
    within = Window.partitionBy("source", "cut").orderBy("h", "did", "th", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ranges, rows["source"].eqNullSafe(ranges["s"]) & (rows["cut"] == ranges["c"]))
    demand = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.coalesce(F.floor(F.try_divide(demand, F.col("source_size"))).cast("long"), F.lit(0))
    before = F.col("ahead") + F.col("inside")
    rest = demand - passes * F.col("source_size") - before
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.select(*more, "did", "th", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), before.cast("long").alias("before"), "ramp")


def position(column_before: Column | None = None) -> Column:
    """Millionths of the training time at which a row is first read; null if never."""
    before = F.col("before") if column_before is None else column_before
    time = training_time(before, F.col("target"), F.col("ramp"))
    return F.when(F.col("taken") > 0, F.floor(time * 1_000_000).cast("long"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix reads them, range-sorted by training
    position: a row that is taken twice stands twice, one never taken goes, and one
    taken in part is cut after its last word taken (words then joined by one space).
    Columns of any name stay as they are."""
    root = common.scratch(docs.sparkSession, "mixing")
    rows = common.numbered(docs, f"{root}/rows")
    mixed = _mixed(sizes(rows.select("rid", "row.doc_id", "row.text", "row.source"), F.col("rid")), root, **options).where("taken > 0")
    mixed = mixed.select("rid", "did", "size", "source_size", "target", "taken", "before", "ramp")
    reads = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    mixed = mixed.withColumn("read", F.explode(reads))
    mixed = mixed.withColumn("at", position(F.col("before") + F.col("read") * F.col("source_size")))
    words = F.least(F.col("size"), F.col("taken") - F.col("read") * F.col("size"))
    some = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("size"), some).otherwise(F.col("row.text"))
    out = rows.join(mixed, "rid").select(F.col("row").withField("text", text).alias("row"), "at", "did")
    return out.repartitionByRange("at", "did").sortWithinPartitions("at", "did").select("row.*")
