"""Suffix-array dedup of long byte strings (a logarithmic index family).

Removes every byte that lies in a ``window``-byte string which also starts
anywhere else.  A suffix array over each byte of a corpus would need its text
beside each suffix, so a *sparse* suffix array is kept: suffixes that start at
content-defined anchors (``anchors``), at least one in every window.

1. Each batch gets its sparse suffix array: suffixes sorted by their leading 128
   bytes (as a hash) and by the stretch they stand for.  It is merge-scanned against
   the arrays of all levels, and equal-sized levels merge geometrically (``levels``).
2. Stretches that occur twice as a whole are marked by that scan.  Where several
   stretches share a suffix head, one of each is read, and the group's suffix array
   and that of its reversed prefixes are built from the bytes.  Adjacent longest
   common prefixes give the length of each match to both sides: a window that starts
   ``o`` bytes before the anchor repeats iff some other stretch matches for ``o``
   bytes to the left and ``window - o`` to the right.
3. Heads that are frequent, or have more than ``dense`` stretches, are not brought
   together: their windows are counted one by one by 128-bit digests, spread over
   all tasks.  The results are the same.

Defined results: a null text is empty; a null doc_id is kept as null; rows that
share a doc_id are separate documents, and repeated rows repeat each other;
texts below ``window`` bytes and empty tables lose nothing; other columns, whatever
their names, are ignored.  Whole stretches are held equal if a rolling hash of their
head and XXH3 of all their bytes agree (64 bits each), the windows of frequent
heads if their 128-bit XXH3 agrees, all others if their bytes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors, common, levels

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PIECES = "key long, rid long, lo long, a int, done boolean, data binary, w1 long, w2 long"
PIECE_LIMIT = 1 << 23
_PAIRED = 256  # larger groups are compared offset by offset, with equal results


def digests(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of each ``flat[start:end]``."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(flat[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)


def wide_digest(data: bytes) -> tuple[int, int]:
    """128-bit XXH3 as two signed numbers."""
    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def member_batch(did, rid, key, s, pab) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([common.longs(x) for x in (key, s, did, rid, pab)], names=["key", "s", "did", "rid", "pab"])


def _members(geo: anchors.Geometry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole)):
            rid, did = batch.column("rid").to_numpy(), batch.column("did").to_numpy()
            texts = common.octets(batch.column("text"))
            for part in anchors.chunks([len(t) for t in texts], geo):
                which, offset, length = (np.array(x, np.int64) for x in zip(*((i, a, b - a) for i, a, b in part), strict=True))
                flat = b"".join(texts[i][a:b] for i, a, b in part)
                base = np.cumsum(length) - length
                found = anchors.find(anchors.byte_elements(flat), base, length, geo)
                seq, lo, hi = found["seq"], found["lo"], found["hi"]
                s = digests(flat, base[seq] + lo, base[seq] + hi + geo.window)
                add = offset[seq]
                yield member_batch(did[which[seq]], rid[which[seq]], found["key"], s, levels.pack(found["pos"] + add, lo + add, hi + add))

    return run


def items_of(lists: pa.ListArray) -> Iterator[list[tuple]]:
    """The questions of each document as (key, pab, single, done), row by row."""
    offsets, values = lists.offsets.to_numpy(), lists.values
    for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        some = values.slice(x, y - x)
        yield list(zip(*(some.field(k).to_pylist() for k in range(4)), strict=True))


def _pieces(window: int):
    """Questioned stretches: their bytes, or one row a window under a frequent head."""
    schema = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("lo", pa.int64()), ("a", pa.int32()), ("done", pa.bool_()), ("data", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = common.Rows(schema, PIECE_LIMIT)
        for batch in (part for whole in batches for part in common.slices(whole)):
            for rid, text, items in zip(batch.column("rid").to_pylist(), common.octets(batch.column("text")), items_of(batch.column("items")), strict=True):
                for key, pab, single, done in items:
                    pos, lo, hi = levels.unpack(pab)
                    if not single:
                        rows.add(key, rid, lo, pos - lo, done, text[lo : hi + window], None, None, size=120 + hi + window - lo)
                        continue
                    for s in range(lo, hi + 1):
                        rows.add(None, rid, s, None, done, None, *wide_digest(text[s : s + window]), size=100)
                    yield from rows.take()
                yield from rows.take()
        yield from rows.take(0)

    return run


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each text in sorted order, and the common prefix length of each
    sorted text with the next."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(texts))
    size = [len(texts[i]) for i in order]
    wide = max(size)
    grid = np.frombuffer(b"".join(texts[i].ljust(wide + 1, b"\0") for i in order), np.uint8).reshape(len(texts), wide + 1)
    same = grid[1:] == grid[:-1]
    same[:, -1] = False
    lcp = same.argmin(axis=1) if len(texts) > 1 else np.zeros(0, np.int64)
    return rank, np.minimum(lcp, np.minimum(size[1:], size[:-1]))


def _all_lcp(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix length of each pair, from adjacent ones."""
    m = len(rank)
    table = np.zeros((m, m), np.int32)
    for i in range(m - 1):
        table[i, i + 1 :] = np.minimum.accumulate(lcp[i:])
    table += table.T
    return table[np.ix_(rank, rank)]


def _by_offset(left: list[bytes], right: list[bytes], window: int) -> Iterator[tuple[int, int, int]]:
    """``repeated_offsets`` in time linear in the group: at each offset, neighbours of
    the sorted order fall into classes of equal context to the left and to the right,
    and a window repeats iff some other text is in both of its classes."""
    (rank_l, lcp_l), (rank_r, lcp_r) = suffix_array(left), suffix_array(right)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    hits = np.zeros((len(left), int(size_l.max()) + 2), bool)
    for o in range(hits.shape[1] - 1):
        some = np.flatnonzero((size_l >= o) & (size_r >= window - o))
        class_l = np.append(0, np.cumsum(lcp_l < o))[rank_l[some]]
        class_r = np.append(0, np.cumsum(lcp_r < window - o))[rank_r[some]]
        pair = class_l * len(left) + class_r
        order = np.argsort(pair, kind="stable")
        same = np.flatnonzero(pair[order[1:]] == pair[order[:-1]])
        hits[some[order[same]], o] = True
        hits[some[order[same + 1]], o] = True
    for i in np.flatnonzero(hits.any(axis=1)):
        edge = np.flatnonzero(np.diff(hits[i].astype(np.int8), prepend=0))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield int(i), x, y - 1


def repeated_offsets(left: list[bytes], right: list[bytes], window: int) -> Iterator[tuple[int, int, int]]:
    """(text, least, most): windows that start least..most bytes before the anchor
    of a text also stand in another text of the group."""
    if len(left) > _PAIRED:
        yield from _by_offset(left, right, window)
        return
    to_left = _all_lcp(*suffix_array(left))
    least = window - _all_lcp(*suffix_array(right))
    np.fill_diagonal(to_left, -1)
    hits = to_left >= np.maximum(least, 0)
    for i in np.flatnonzero(hits.any(axis=1)):
        lo, hi = np.maximum(least[i, hits[i]], 0), to_left[i, hits[i]] + 1
        for x, y in zip(*common.merged_ranges(lo, hi), strict=True):
            yield int(i), int(x), int(y) - 1


def _compared(window: int):
    """Key-sorted stretches -> marks of the windows that others of the key share."""
    schema = pa.schema([("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = common.Rows(schema, 1 << 20)
        for table in common.by_key(batches):
            key, rid, lo, a = (table.column(c).to_numpy() for c in ("key", "rid", "lo", "a"))
            done, data = table.column("done").to_pylist(), table.column("data")
            cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if y - x > 1 and not all(done[x:y]):
                    whole = data.slice(x, y - x).to_pylist()
                    left = [d[:n][::-1] for d, n in zip(whole, a[x:y].tolist(), strict=True)]
                    right = [d[n:] for d, n in zip(whole, a[x:y].tolist(), strict=True)]
                    for i, least, most in repeated_offsets(left, right, window):
                        if not done[x + i]:
                            first = int(lo[x + i]) + int(a[x + i])
                            rows.add(int(rid[x + i]), first - most, first - least)
            yield from rows.take()
        yield from rows.take(0)

    return run


def _cut(window: int):
    """Rows with their repeated window starts -> spans, size and kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole)):
            spans, sizes, rest = [], [], []
            for text, starts in zip(common.octets(batch.column("text")), batch.column("starts"), strict=True):
                own, kept = [], text
                if starts.values is not None and len(starts.values):
                    lo, hi = (starts.values.field(k).to_numpy() for k in (0, 1))
                    lo, hi = common.merged_ranges(lo, hi + window)
                    own = [{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                spans.append(own)
                sizes.append(len(text))
                rest.append(kept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(spans, common.arrow_type(_SPANS)), common.longs(sizes), pa.array(rest, pa.binary())], names=[*batch.schema.names[:-2], "spans", "n_bytes", "kept"])

    return run


class SuffixIndex(levels.RepeatIndex):
    """The index family in a folder: ``add`` batches of documents, ask for ``cuts`` at
    any time; opened again on the same folder, it goes on with the next batch."""

    def __init__(self, spark: SparkSession, root: str, window: int = 400, fanout: int = 2, dense: int = 20_000, lasting: bool = True):
        self.window = window
        geo = anchors.geometry(window, words=False)
        super().__init__(spark, root, lambda texts: texts.mapInArrow(_members(geo), levels.MEMBER), self._windows, later=False, fanout=fanout, dense=dense, lasting=lasting)

    def _windows(self, known: DataFrame, folder: str, base: int) -> DataFrame:
        pieces = common.settle(known.select("rid", "text", "items").mapInArrow(_pieces(self.window), _PIECES), folder)
        common.free_shuffles(self.spark)
        near = pieces.where("w1 is null").select("key", "rid", "lo", "a", "done", "data")
        near = near.repartition(F.col("key")).sortWithinPartitions("key", "rid", "lo").mapInArrow(_compared(self.window), levels.MARK)
        single = pieces.where("w1 is not null").select("w1", "w2", "rid", "lo", "done")
        twice = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        far = single.where("not done").join(twice, ["w1", "w2"]).select("rid", "lo", F.col("lo").alias("hi"))
        return near.unionAll(far)

    def marked(self) -> DataFrame:
        """(rid, row, starts) of all batches."""
        starts = self.marks().groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
        return self.rows().join(starts.hint("shuffle_hash"), "rid", "left")

    def cuts(self, whole_rows: bool = False) -> DataFrame:
        """(doc_id, spans, n_bytes, kept) per document, or (row, ...) with its row."""
        own = F.col("row") if whole_rows else F.col("row.doc_id").cast("long").alias("doc_id")
        rows = self.marked().select(own, common.row_text().alias("text"), "starts")
        schema = T.StructType([rows.schema[0], T.StructField("spans", _SPANS), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType())])
        return rows.mapInArrow(_cut(self.window), schema)


def _indexed(docs: DataFrame, window: int, batches: int, fanout: int, dense: int, finish: bool = True) -> SuffixIndex:
    index = SuffixIndex(docs.sparkSession, common.scratch(docs.sparkSession, "suffix-dedup"), window, fanout, dense, lasting=False)
    batch = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(batches))
    for i in range(batches):
        index.add(docs.where(batch == i))
    if finish:
        index.finish()
    return index


def suffix_dedup(docs: DataFrame, window: int = 400, batches: int = 3, fanout: int = 2, dense: int = 20_000) -> DataFrame:
    """(doc_id, spans, n_bytes, kept): removed byte ranges and remaining bytes of
    each document. ``batches``: how many parts the documents arrive in; ``fanout``:
    runs a level holds before they merge; ``dense``: stretches under one suffix head
    beyond which windows are counted one by one. See the module for its rules."""
    index = _indexed(docs, window, batches, fanout, dense)
    if not index.state["batches"]:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", _SPANS), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType())]))
    return index.cuts()


def without_repeats(docs: DataFrame, window: int = 400, batches: int = 3, fanout: int = 2, dense: int = 20_000) -> DataFrame:
    """The rows of ``docs`` with their text less what repeats; a character cut in
    two by the end of a span goes with it. Documents keep their row, and a null
    text stays null."""
    index = _indexed(docs, window, batches, fanout, dense)
    if not index.state["batches"]:
        return docs
    whole = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", "")
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col("row.text"))
    return index.cuts(whole_rows=True).select(F.col("row").withField("text", text).alias("row")).select("row.*")
