"""A log-structured index of long repeats, shared by the two exact operators.

The index grows by ``add``, batch after batch, and lies in one folder: the rows of
each batch, its sorted *runs* by level, the marks found so far and a manifest, by
which it can be opened again.

A run is an immutable table, sorted by suffix: one row (key, s, did, rid, pab) for
each distinct stretch of windows, where ``key`` hashes the suffix's head at a
content-defined anchor (``anchors``), ``s`` digests the bytes of the whole stretch
and (rid, pab) is its first member's place.  ``add`` sorts the batch's own suffixes
into those of all levels and scans the merged order once, with these outcomes:

* a new stretch that stands there already, as a whole, is marked at once;
* where several stretches share a head, only their first members are asked for:
  their text is read, and windows are compared exactly (``detail``);
* new distinct stretches are the batch's own run, of level 0;
* if the lowest level that holds ``fanout`` runs is due, its rows leave the same scan
  as one run of the next level.  Each row is rewritten a logarithmic number of times.

No group is ever brought together to be compared pair by pair, and none can swell a
task: heads that a sample of documents shows to be frequent are dealt out over
several tasks (*salted*).  Salted rows that the scan then fails to see beside each
other are only asked for needlessly, so the sample steers the work and not the result.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MEMBER = "key long, s long, did long, rid long, pab long"
ITEM = "key long, pab long, single boolean, done boolean"
MARK = "rid long, lo long, hi long"
_SCAN = "kind int, key long, s long, did long, rid long, pab long, single boolean, done boolean, salted boolean"
_RUN, _MARKED, _ASKED, _MERGED = range(4)
_STAYS, _MOVES, _NEW = range(3)

_BITS = 12


def pack(pos, lo, hi):
    """pos, pos - lo and hi - lo in one long."""
    return (pos << 2 * _BITS) | ((pos - lo) << _BITS) | (hi - lo)


def unpack(pab):
    mask = (1 << _BITS) - 1
    pos = pab >> 2 * _BITS
    lo = pos - ((pab >> _BITS) & mask)
    return pos, lo, lo + (pab & mask)


def _scanned(later: bool, dense: int):
    """Rows sorted by (key, s, src, did, rid, pab) -> runs, marks and questions."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("s", pa.int64()), ("did", pa.int64()), ("rid", pa.int64()), ("pab", pa.int64()), ("single", pa.bool_()), ("done", pa.bool_()), ("salted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.by_key(batches):
            key, s, src, salted = (table.column(c).to_numpy() for c in ("key", "s", "src", "salted"))
            head = np.append(True, key[1:] != key[:-1])
            first = head | np.append(True, s[1:] != s[:-1])
            again = np.append(~first[1:], False)
            begin = np.flatnonzero(head)
            group = np.cumsum(head) - 1
            kinds = np.add.reduceat(first.astype(np.int64), begin)
            touched = np.maximum.reduceat(src, begin) == _NEW
            open_ = (((kinds > 1) | np.logical_or.reduceat(salted, begin)) & touched)[group]
            alone = (kinds > dense)[group]
            new, repeated = src == _NEW, ~first | again
            marked = (new & ~first) if later else repeated
            for kind, rows in ((_RUN, new & first), (_MARKED, marked), (_ASKED, first & open_), (_MERGED, (src == _MOVES) & first)):
                at = np.flatnonzero(rows)
                if len(at):
                    some = table.select(["key", "s", "did", "rid", "pab"]).take(pa.array(at)).combine_chunks()
                    done = pa.array((repeated & (not later))[at])
                    columns = [some.column(c).chunk(0) for c in some.column_names]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *columns, pa.array(alone[at]), done, pa.array(salted[at])], schema=schema)

    return run


class RepeatIndex:
    """``members``: rows (rid, did, text) -> ``MEMBER``.  ``detail``: (documents with
    their questions, folder) -> marks, for windows of stretches that share a head.
    ``later``: mark only what stands earlier too (in the index, or in the batch by doc_id,
    row and place); else every place of a repeat, those of earlier batches included.
    ``lasting``: the index can be opened again whenever it stops; without, what a batch
    has merged goes at once, which needs less disk."""

    def __init__(self, spark: SparkSession, root: str, members: Callable[[DataFrame], DataFrame], detail: Callable[[DataFrame, str, int], DataFrame], *, later: bool, fanout: int = 2, dense: int = 20_000, lasting: bool = True):
        self.spark, self.root, self.later, self.fanout, self.dense, self.lasting = spark, root, later, max(fanout, 2), dense, lasting
        self._members, self._detail = members, detail
        self.state = {"step": 0, "batches": 0, "base": 0, "levels": [], "rows": [], "marks": [], "retired": []}
        self._reopened()

    def _reopened(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            kept = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.root}/manifest").collect()]  # one line a step
            self.state = max(kept, key=lambda x: x["step"])

    def _commit(self, state: dict) -> None:
        """Put a new state in place, under a name of its own, and only then drop what it no
        longer names: whenever this stops, the index is the old one or the new one."""
        state["step"] += 1
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        target, part = path(f"{self.root}/manifest/{state['step']}.json"), path(f"{self.root}/manifest/_{state['step']}.part")
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = system.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not system.rename(part, target):
            raise OSError(f"could not write {target}")
        self.state = state
        self._swept()

    def _swept(self) -> None:
        """Drop what steps before this one gave up, and what a stopped ``add`` left."""
        k = self.state["batches"]
        for path in [*self.state["retired"], *(f"{self.root}/{name}-{k}" for name in ("rows", "scan", "marks", "detail"))]:
            common.drop(self.spark, path)

    def _runs(self, paths: list[str], src: int) -> list[DataFrame]:
        return [self.spark.read.schema(MEMBER).parquet(p).withColumn("src", F.lit(src)) for p in paths]

    def rows(self) -> DataFrame:
        """(rid, row) of all batches, at least one; their columns must be alike."""
        paths = self.state["rows"]
        return self.spark.read.schema(self.spark.read.parquet(paths[-1]).schema).parquet(*paths)

    def _texts(self, paths: list[str]) -> DataFrame:
        """(rid, did, text) of the rows at ``paths``."""
        frames = [self.spark.read.parquet(p).select("rid", common.row_doc_id().alias("did"), common.row_text().alias("text")) for p in paths]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionAll(more)
        return out

    def marks(self) -> DataFrame:
        """(rid, lo, hi): repeated window starts, inclusive, of all batches so far."""
        return self.spark.read.schema(MARK).parquet(*self.state["marks"])

    def _frequent(self, texts: DataFrame, total: int, runs: list[DataFrame], tasks: int) -> DataFrame | None:
        """(key, parts) of heads that would fill half a task or more: 2 * ``tasks``
        rows at most, from a sample of documents and of the runs' rows."""
        rate = min(1.0, (4000 + 4 * tasks) / max(total, 1))
        chance = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 20)) < int((1 << 20) * rate)
        some = self._members(texts.where(chance("rid"))).select("key")
        for run in runs:
            some = some.unionAll(run.where(chance("rid", "pab")).select("key"))
        counts = some.rollup("key").agg(F.count(F.lit(1)).alias("n"), F.grouping("key").alias("all")).orderBy(F.desc("all"), F.desc("n")).limit(2 * tasks + 1).collect()
        seen = counts[0]["n"] if counts else 0
        least = max(8, seen / (2 * tasks))
        found = [(r["key"], min(-(-r["n"] * 2 * tasks // seen), tasks)) for r in counts[1:] if r["n"] >= least]
        return self.spark.createDataFrame(found, "key long, parts int") if found else None

    def add(self, docs: DataFrame) -> None:
        """A new batch of documents (doc_id, text and any other columns). It counts once all
        of it is written; stopped before, it leaves the index as it was and can be added
        again."""
        self._swept()
        spark, state, k = self.spark, copy.deepcopy(self.state), self.state["batches"]
        state["retired"] = []
        rows = common.numbered(docs, f"{self.root}/rows-{k}", state["base"])
        last, total = rows.agg(F.max("rid"), F.count("rid")).first()
        if last is None:  # an empty batch leaves no trace
            common.drop(spark, f"{self.root}/rows-{k}")
            return
        texts = rows.select("rid", common.row_doc_id().alias("did"), common.row_text().alias("text"))
        due = next((i for i, runs in enumerate(state["levels"]) if len(runs) >= self.fanout), None)
        old = [f for i, runs in enumerate(state["levels"]) for f in self._runs(runs, _MOVES if i == due else _STAYS)]
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        frequent = self._frequent(texts, total, old, tasks)
        merged = self._members(texts).withColumn("src", F.lit(_NEW))
        for run in old:
            merged = merged.unionByName(run)
        salt, salted = F.lit(0), F.lit(False)
        if frequent is not None:
            merged = merged.join(F.broadcast(frequent), "key", "left")
            salt, salted = F.coalesce(F.pmod(F.xxhash64("rid", "pab"), "parts"), F.lit(0)), F.col("parts").isNotNull()
        merged = merged.select("key", "s", "src", "did", "rid", "pab", salt.cast("int").alias("salt"), salted.alias("salted"))
        merged = merged.repartition("key", "salt").sortWithinPartitions("key", "s", "src", "did", "rid", "pab").drop("salt")
        scan = merged.mapInArrow(_scanned(self.later, self.dense), _SCAN).sortWithinPartitions("kind", "key", "s")
        scan.write.partitionBy("kind").option("compression", "zstd").parquet(f"{self.root}/scan-{k}")
        del scan, merged
        common.free_shuffles(spark)

        state["rows"].append(f"{self.root}/rows-{k}")
        found = spark.read.schema(_SCAN).parquet(f"{self.root}/scan-{k}")
        lo, hi = starts_of(F.col("pab"))
        marked = found.where(F.col("kind") == _MARKED).select("rid", lo.alias("lo"), hi.alias("hi"))
        marked.write.parquet(f"{self.root}/marks-{k}/whole")
        common.drop(spark, f"{self.root}/scan-{k}/kind={_MARKED}")
        if due is not None and not self.lasting:
            for path in state["levels"][due]:
                common.drop(spark, path)
        asked = found.where(F.col("kind") == _ASKED)
        if frequent is not None:  # no more heads than there are in ``frequent``
            crowded = asked.where("salted").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.dense)
            crowded = [(r["key"], True) for r in crowded.collect()]
            if crowded:
                crowded = spark.createDataFrame(crowded, "key long, crowded boolean")
                asked = asked.join(F.broadcast(crowded), "key", "left").withColumn("single", F.col("single") | F.coalesce("crowded", F.lit(False)))
        asked = asked.groupBy("rid").agg(F.collect_list(F.struct("key", "pab", "single", "done")).alias("items"))
        known = self._texts(state["rows"]).join(asked.hint("shuffle_hash"), "rid")
        self._detail(known, f"{self.root}/detail-{k}", state["base"]).write.parquet(f"{self.root}/marks-{k}/parts")
        del asked, known
        common.drop(spark, f"{self.root}/detail-{k}")
        common.free_shuffles(spark)

        state["marks"] += [f"{self.root}/marks-{k}/whole", f"{self.root}/marks-{k}/parts"]
        if due is not None:
            state["retired"] += state["levels"][due]
            state["levels"][due] = []
            self._put(state["levels"], due + 1, f"{self.root}/scan-{k}/kind={_MERGED}")
        self._put(state["levels"], 0, f"{self.root}/scan-{k}/kind={_RUN}")
        state["retired"] += [f"{self.root}/scan-{k}/kind={kind}" for kind in (_MARKED, _ASKED)]
        state["base"], state["batches"] = ((last >> 33) + 1) << 33, k + 1
        self._commit(state)

    def finish(self) -> None:
        """No more batches: the runs go, rows and marks stay."""
        state = copy.deepcopy(self.state)
        state["retired"] = [p for runs in state["levels"] for p in runs]
        state["levels"] = []
        self._commit(state)

    def _put(self, levels: list[list[str]], level: int, path: str) -> None:
        while len(levels) <= level:
            levels.append([])
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):  # a batch may hold nothing new
            levels[level].append(path)


def starts_of(pab):
    """Columns: the first and the last window start of a packed anchor."""
    mask = F.lit((1 << _BITS) - 1).cast("long")
    lo = F.shiftright(pab, 2 * _BITS) - F.shiftright(pab, _BITS).bitwiseAND(mask)
    return lo, lo + pab.bitwiseAND(mask)
