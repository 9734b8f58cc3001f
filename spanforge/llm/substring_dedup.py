"""Substring dedup: a log-structured fingerprint index over word windows.

Removes each word that lies in a window of ``window`` words whose sequence also
starts earlier (smaller doc_id, or the same document further left).  Window
hashes are kept at content-defined anchors (``anchors``), about one in eight,
which loses no match: equal windows have their anchor at the same place.

1. Each batch becomes a sorted immutable run.  It is merged with the runs of
   history in one sorted scan; runs are compacted as levels fill up (``levels``).
2. A stretch of windows that stands in the index as a whole is marked by that scan.
   The digest of its words is no window hash but another one, of all its bytes.
3. Where different stretches share an anchor, one of each is read, and their windows
   are verified word by word; under frequent anchors window by window by 128-bit
   digests, spread over all tasks.

Batches are ranges of doc_id, added in their order, so that history is what stands
earlier.  ``SubstringIndex`` keeps the index for later batches: whatever it holds
counts as earlier.

Defined results: a null text has no words; null doc_ids come first; rows that
share a doc_id are separate documents, in the order in which they are read, so of
identical rows all but one lose what they repeat; texts below ``window`` words and
empty tables lose nothing; other columns, whatever their names, are ignored.  Whole
stretches are held equal if a hash of the five words at their anchor and XXH3 of all
their words agree (64 bits each).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors, common, levels
from .suffix_dedup import PIECE_LIMIT, digests, items_of, member_batch, wide_digest

_KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
_PIECES = "key long, new boolean, did long, rid long, start long, data binary, w1 long, w2 long"
_GAP = re.compile(rb"[\x09-\x0d\x20]")
PART = 1 << 20


class _WordHashes(dict):
    """Hash of a word, remembered for up to ``limit`` words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_parts(text: bytes, overlap: int, limit: int = PART) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of parts of about ``limit`` bytes, each of
    which begins with the last ``overlap`` words of the one before."""
    if len(text) <= limit:
        yield 0, text.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
        return
    at, first, words = 0, 0, []
    while at < len(text):
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        back = words[-overlap:] if overlap else []
        first += len(words) - len(back)
        words = back + text[at:end].split()
        yield first, words
        at = end


def _members(geo: anchors.Geometry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in (part for whole in batches for part in common.slices(whole)):
            sequences, which, first = [], [], []
            for i, text in enumerate(common.octets(batch.column("text"))):
                for at, words in word_parts(text, geo.window - 1):
                    sequences.append(words)
                    which.append(i)
                    first.append(at)
            rid, did = batch.column("rid").to_numpy(), batch.column("did").to_numpy()
            which, first = np.array(which, np.int64), np.array(first, np.int64)
            for part in anchors.chunks([len(w) for w in sequences], geo):
                words = [w for i, a, b in part for w in sequences[i][a:b]]
                index, offset, length = (np.array(x, np.int64) for x in zip(*((i, a, b - a) for i, a, b in part), strict=True))
                values = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                base = np.cumsum(length) - length
                found = anchors.find(values, base, length, geo)
                seq, lo, hi = found["seq"], found["lo"], found["hi"]
                begin = np.cumsum([0, *(len(w) + 1 for w in words)])
                s = digests(b" ".join(words), begin[base[seq] + lo], begin[base[seq] + hi + geo.window] - 1)
                add, row = (offset + first[index])[seq], which[index][seq]
                yield member_batch(did[row], rid[row], found["key"], s, levels.pack(found["pos"] + add, lo + add, hi + add))

    return run


def _pieces(window: int, base: int):
    """Questioned stretches: their words, or one row a window under a frequent anchor."""
    schema = pa.schema([("key", pa.int64()), ("new", pa.bool_()), ("did", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("data", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])
    reach = 2 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = common.Rows(schema, PIECE_LIMIT)
        for batch in (part for whole in batches for part in common.slices(whole)):
            for did, rid, text, items in zip(batch.column("did").to_pylist(), batch.column("rid").to_pylist(), common.octets(batch.column("text")), items_of(batch.column("items")), strict=True):
                todo = sorted((levels.unpack(pab)[1:], key, single) for key, pab, single, _ in items)
                k = 0
                for first, words in word_parts(text, reach):
                    end = first + len(words)
                    while k < len(todo) and todo[k][0][1] + window <= end:
                        (lo, hi), key, single = todo[k]
                        k += 1
                        some = words[lo - first : hi - first + window]
                        if not single:
                            data = b" ".join(some)
                            rows.add(key, rid >= base, did, rid, lo, data, None, None, size=120 + len(data))
                            continue
                        for s in range(hi - lo + 1):
                            rows.add(None, rid >= base, did, rid, lo + s, None, *wide_digest(b" ".join(some[s : s + window])), size=100)
                    yield from rows.take()
        yield from rows.take(0)

    return run


def _verified(window: int):
    """Stretches sorted by key and place -> marks of windows whose words stand in an
    earlier stretch of the key."""
    schema = pa.schema([("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = common.Rows(schema, 1 << 20)
        for table in common.by_key(batches):
            key, new, rid, start = (table.column(c).to_numpy() for c in ("key", "new", "rid", "start"))
            data = table.column("data")
            cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if y - x == 1:
                    continue
                seen: set[tuple[bytes, ...]] = set()
                for i, stretch in enumerate(data.slice(x, y - x).to_pylist(), x):
                    words = stretch.split(b" ")
                    own = [tuple(words[k : k + window]) for k in range(len(words) - window + 1)]
                    if new[i]:
                        for k, w in enumerate(own, int(start[i])):
                            if w in seen:
                                rows.add(int(rid[i]), k, k)
                    seen.update(own)
            yield from rows.take()
        yield from rows.take(0)

    return run


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole)):
            sizes, gone, rest = [], [], []
            for text, starts in zip(common.octets(batch.column("text")), batch.column("starts"), strict=True):
                lo = hi = np.zeros(0, np.int64)
                if starts.values is not None and len(starts.values):
                    lo, hi = (starts.values.field(k).to_numpy() for k in (0, 1))
                    lo, hi = common.merged_ranges(lo, hi + window)
                kept, n = [], 0
                for first, words in word_parts(text, 0):
                    n = first + len(words)
                    own = slice(int(np.searchsorted(hi, first, side="right")), int(np.searchsorted(lo, n)))
                    x, y = np.clip(lo[own], first, n) - first, np.clip(hi[own], first, n) - first
                    edges = [0, *np.stack([x, y], 1).ravel().tolist(), len(words)]
                    some = [w for p, q in zip(edges[::2], edges[1::2], strict=True) for w in words[p:q]]
                    if some:
                        kept.append(b" ".join(some))
                removed = int((hi - lo).sum())
                sizes.append(n)
                gone.append(removed)
                rest.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), common.longs(sizes), common.longs(gone), pa.array(rest, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


class SubstringIndex(levels.RepeatIndex):
    """The index in a folder: ``add`` batches of documents, ask for ``cuts`` at any
    time; opened again on the same folder, it goes on with the next batch."""

    def __init__(self, spark: SparkSession, root: str, window: int = 20, fanout: int = 2, dense: int = 20_000, lasting: bool = True):
        self.window = window
        geo = anchors.geometry(window, words=True)
        super().__init__(spark, root, lambda texts: texts.mapInArrow(_members(geo), levels.MEMBER), self._windows, later=True, fanout=fanout, dense=dense, lasting=lasting)

    def _windows(self, known: DataFrame, folder: str, base: int) -> DataFrame:
        pieces = common.settle(known.select("did", "rid", "text", "items").mapInArrow(_pieces(self.window, base), _PIECES), folder)
        common.free_shuffles(self.spark)
        near = pieces.where("w1 is null").select("key", "new", "did", "rid", "start", "data")
        near = near.repartition(F.col("key")).sortWithinPartitions("key", "new", "did", "rid", "start").mapInArrow(_verified(self.window), levels.MARK)
        single = pieces.where("w1 is not null").select("w1", "w2", F.struct("new", "did", "rid", "start").alias("place"))
        least = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")).where("n > 1").drop("n")
        far = single.where("place.new").join(least, ["w1", "w2"]).where("place <> least")
        return near.unionAll(far.select("place.rid", F.col("place.start").alias("lo"), F.col("place.start").alias("hi")))

    def cuts(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept) per document of all batches."""
        starts = self.marks().groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
        rows = self.rows().join(starts.hint("shuffle_hash"), "rid", "left")
        return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), common.row_text().alias("text"), "starts").mapInArrow(_keep(self.window), _KEPT)


def substring_dedup(docs: DataFrame, window: int = 20, batches: int = 3, fanout: int = 2, dense: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the remaining words joined
    by one space. ``batches``: ranges of doc_id the documents arrive in; ``fanout``:
    runs a level holds before they merge; ``dense``: stretches under one anchor beyond
    which windows are compared by digests. See the module for its rules."""
    spark = docs.sparkSession
    index = SubstringIndex(spark, common.scratch(spark, "substring-dedup"), window, fanout, dense, lasting=False)
    ident = F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NO_ID).cast("long"))
    cuts = docs.select(ident.cast("double").alias("i")).approxQuantile("i", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        some = docs
        if low is not None:
            some = some.where(ident.cast("double") > low)
        if high is not None:
            some = some.where(ident.cast("double") <= high)
        index.add(some)
    index.finish()
    if not index.state["batches"]:
        return spark.createDataFrame([], _KEPT)
    return index.cuts()
