"""Best-fit packing of tokenized documents into sequences.

Best-fit decreasing: pieces go longest first, each into the tightest open bin
that still takes it, found by a segment tree over remaining capacities.  Lengths
are whole numbers up to the sequence length, so bins of equal remaining capacity
are alike, and pieces of equal length too: the plan is drawn up on the driver from
the number of pieces of each length (2048 numbers, whatever the data), as runs of
bins that take runs of pieces.  It is the very packing that placing the pieces one
by one gives.  Pieces are numbered within their length by salted ranges and find
their bin by binary search in the plan.

A document is its token ids, then ``end``; one longer than a sequence is cut into
pieces of full length, the first of which may be shorter.

Defined results: null text is empty (one piece, the end token); a null doc_id is
kept; rows that share a doc_id are separate documents; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, END = 2048, 0
_PIECE = "did long, th long, piece int, start long, length int, ids_crc32 long, ids binary"


#: Texts of these characters only have one reading in any regex engine.
_PLAIN = re.compile("[\t\n\r !-~\u00a1-\u024f]*")
#: Fixed value: the pattern that byte-level tokenizers split text by before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _fast_encoder(path: str):
    """An encoder of the file's own vocabulary and merges with less overhead;
    None if its merges are not in the order of its ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(pairs)):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class TextTokens:
    """Token ids of texts, as little-endian 32-bit numbers. Plain texts go through the
    faster encoder, all others through the tokenizer itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = _fast_encoder(path) if sys.byteorder == "little" else None

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: str) -> bytes:
        if self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return self.direct(text)


_loaded: dict[str, TextTokens] = {}


def _pieces(path: str, length: int, end: int, with_ids: bool):
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = TextTokens(path)
        tokens = _loaded[path]
        rows = common.Rows(schema, 1 << 23)
        for batch in batches:
            for did, th, text in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokens.of(text) + last
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = ids[4 * a : 4 * b]
                    rows.add(did, th, i, a, b - a, zlib.crc32(part), part if with_ids else None, size=80 + with_ids * len(part))
                yield from rows.take()
        yield from rows.take(0)

    return run


class CapacityTree:
    """Segment tree over remaining capacities 0..top: how many bins are open."""

    def __init__(self, top: int):
        self.leaves = 1
        while self.leaves <= top:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += bins
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(pieces: dict[int, int], top: int) -> np.ndarray:
    """Plan for ``pieces[length]`` pieces of each length: rows (length, first rank,
    bins, first bin, first offset). Piece ``rank`` of a row's ``bins * q`` lies in bin
    ``first + (rank - first rank) % bins``, as its ``(rank - first rank) // bins``-th."""
    tree, open_, rows, bins = CapacityTree(top), [[] for _ in range(top + 1)], [], 0

    def fill(length: int, rank: int, left: int, first: int, n: int, room: int) -> int:
        """Put up to ``left`` pieces into ``n`` bins with ``room``; how many went in."""
        each = room // length
        whole = min(n, left // each)
        if whole:
            rows.append((length, rank, whole, first, top - room))
            keep(room - each * length, first, whole)
        put = whole * each
        if whole < n and left > put:
            rest = left - put
            rows.append((length, rank + put, 1, first + whole, top - room))
            keep(room - rest * length, first + whole, 1)
            put, whole = left, whole + 1
        if whole < n:
            keep(room, first + whole, n - whole)
        return put

    def keep(room: int, first: int, n: int) -> None:
        if room:
            open_[room].append((first, n))
            tree.add(room, n)

    for length in sorted(pieces, reverse=True):
        rank, left = 0, pieces[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (top // length))
                put = fill(length, rank, left, bins, n, top)
                bins += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
                put = fill(length, rank, left, first, n, room)
            rank, left = rank + put, left - put
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _placed(plan):
    """(…, length, rank) -> (…, sequence_id, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        width = np.int64(1) << np.int64(48)
        keys = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            y, n = rank - rows[at, 1], rows[at, 2]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows[at, 3] + y % n), pa.array(rows[at, 4] + y // n * length)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False, salts: int = 512) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) per piece.
    ``path`` is a tokenizers file, ``with_ids`` adds the token ids themselves; pieces of
    one length are numbered in ``salts`` ranges, each in one task.
    See the module for its rules."""
    spark = docs.sparkSession
    root = common.scratch(spark, "packing")
    kept = ["did", "th", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    pieces = common.identified(docs).mapInArrow(_pieces(path, length, end, with_ids), _PIECE).select(*kept)
    pieces = common.settle(pieces.withColumn("salt", F.pmod(F.xxhash64("did", "th", "piece"), F.lit(salts)).cast("int")), f"{root}/pieces")
    counts = common.settle(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), f"{root}/counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_decreasing(histogram, length))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    ranges = counts.select("length", "salt", ahead)
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("did", "th", "piece")) - 1
    ranked = pieces.withColumn("number", number).join(ranges, ["length", "salt"]).withColumn("rank", (F.col("ahead") + F.col("number")).cast("long"))
    ranked = ranked.select(*kept, "rank")
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    placed = ranked.mapInArrow(_placed(plan), schema)
    return placed.select(common.doc_id_back().alias("doc_id"), *[c for c in placed.columns if c not in ("did", "th")])
