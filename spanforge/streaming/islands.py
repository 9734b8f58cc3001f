"""Islands of a stream: runs of equal labels, as ``operators.intervals.islands`` finds them.

Whether a row joins an island hangs on the row before it, so a key's rows wait in state
until the watermark has passed them (by then none can come before them) and are taken
in order.  The open island is given out when a row of another label or beyond the gap
ends it, or when the watermark has passed the last moment at which a row could join.
A row behind the watermark is dropped by Spark.  State for a key: the rows of one
watermark's delay, and one island.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_WAITING = "start long, id long, end long, label string"
_OPEN = "island int, is_open boolean, label string, start long, end long, ids array<long>"


class _Islands(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = [(r["start"], r["id"], r["end"], r["label"]) for r in rows if r["start"] is not None and r["key"] is not None]
        if not fresh:
            return
        self.waiting.appendList(fresh)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key, watermark: int) -> Iterator[Row]:
        """Take the rows before ``watermark`` (milliseconds) in order."""
        passed = watermark * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] < passed]
        now = tuple(self.open.get()) if self.open.exists() else (-1, False, None, 0, 0, [])
        for start, id_, end, label in ready:
            island, is_open, last, first, reach, ids = now
            if is_open and label == last and start <= reach + self.gap:
                now = (island, True, label, first, max(reach, end), [*ids, id_])
            else:
                if is_open:
                    yield self._row(key, now)
                now = (island + 1, True, label, start, end, [id_])
        if now[1] and now[4] + self.gap < passed:
            yield self._row(key, now)
            now = (now[0], False, now[2], 0, 0, [])
        left = rows[len(ready) :]
        if ready:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        if now[0] >= 0:
            self.open.update(now)
        for moment in ([left[0][0]] if left else []) + ([now[4] + self.gap] if now[1] else []):
            self.handle.registerTimer(moment // 1000 + 1)

    @staticmethod
    def _row(key, now) -> Row:
        island, _, label, start, end, ids = now
        return Row(key=key[0], island=island, start=start, end=end, label=label, ids=list(ids), n=len(ids))


def islands(stream: DataFrame, key: str, ts: str, start: str, end: str, id_: str, label: str, gap: int, late: str = "1 day") -> DataFrame:
    """(key, island, start, end, label, ids, n) of a stream: ``start`` and ``end`` are
    microseconds, ``ts`` the timestamp of ``start``, ``gap`` in microseconds. Rows of one
    start are taken by id. The last islands stay open until the watermark passes them:
    a row of a null key far in the future (``flush_row``) drains a stream that has ended."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, late).select(ts, F.col(key).alias("key"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(id_).cast("long").alias("id"), F.col(label).cast("string").alias("label"))
    out = f"key {kind}, island int, start long, end long, label string, ids array<long>, n long"
    found = rows.groupBy("key").transformWithState(statefulProcessor=_Islands(gap), outputStructType=out, outputMode="append", timeMode="eventTime")
    return found.where("key IS NOT NULL").withColumnRenamed("key", key)


def flush_row(rows: DataFrame, ts: str, years: int = 50) -> DataFrame:
    """One row like those of ``rows``, null but for a ``ts`` far behind the last."""
    last = rows.agg(F.max(ts).alias("last"))
    return last.select(*[((F.col("last") + F.make_interval(years=F.lit(years))) if c == ts else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(found: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, exactly once into Parquet, and read the rows back.
    State is kept in RocksDB, which ``transformWithState`` needs."""
    spark = found.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(found.schema).parquet(path)
