"""SimHash near-dedup by anchor-point covering.

Fingerprint: of the XXH64 values (seed 42) of a text's ``width``-word shingles,
a bit is 1 if it is set in over half of them.  A ``Layout`` names the number of
64-bit words, how many bits linked fingerprints may differ in, and the parts that
the bits are split into.  Words after the first come from mixes of the same values.

A coded part has 22 bits.  Its anchors are the words of a covering code, the product
of the perfect Hamming codes of length 15 and 7 (covering radius 1 each): each
fingerprint is at home at its nearest anchor and is replicated to each anchor that
is home to a word at distance 1, all of them within covering radius plus threshold;
so of two fingerprints that differ in at most one bit of a part, one finds the other
at its home.  At most 11 rows a fingerprint and part, whatever the data.

``EXACT``: 4 of 64 bits, parts of 22, 22 and 20 bits, the last its own anchor.  Of 4
differing bits at most 1 falls on the first part, or at most 1 on the second, or none
on the third: no link is lost.

``SIMILAR``: 44 of 256 bits, eleven coded parts.  Shingle counts with Jaccard
similarity j have cosine about 2j / (1 + j) and differ in the share arccos / pi of
the bits: 39 of 256 at 0.8, 49 at 0.7, 128 if unrelated, a text that repeats a few
lines aside.  Not every pair within the bits meets at an anchor: the README gives the
shares of edited copies that link.  ``similar`` confirms such pairs by their shingles.

Equal fingerprints are one row throughout.  An anchor with more than ``crowd`` rows
is cut into blocks, and each pair of a block of residents and one of visitors is a
part of its own, so no task holds a whole crowded anchor.  Each anchor gives out a spanning forest of the
links found there, never all pairs.

Defined results: fewer words than a shingle: the whole sequence is hashed; no
words or null text: fingerprint zero, linked like any other; a null doc_id is the
smallest; rows that share a doc_id are separate rows of that id; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected, forest

class Layout(NamedTuple):
    words: int  # of 64 bits
    bits: int  # that linked fingerprints may differ in
    parts: tuple[tuple[int, bool], ...]  # first bit, has a covering code
    together: int  # parts compared in one pass; bounds what a pass shuffles

    @property
    def columns(self) -> list[str]:
        """The words of a fingerprint, then its node if that is not the only word."""
        return ["fp"] if self.words == 1 else [*(f"fp{i}" for i in range(self.words)), "node"]

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} long" for c in self.columns)

    def passes(self) -> list[Layout]:
        return [self._replace(parts=self.parts[i : i + self.together]) for i in range(0, len(self.parts), self.together)]


EXACT = Layout(1, 4, ((0, True), (22, True), (44, False)), 3)
SIMILAR = Layout(4, 44, tuple((22 * i, True) for i in range(11)), 4)
_PAIRS = 1 << 21
_STEP = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th further 64-bit hash of 64-bit hashes (splitmix64's finalizer)."""
    z = h + np.uint64(k * _STEP & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes, width: int = 4) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of UTF-8 bytes, repeats included."""
    tokens = text.lower().split()  # ASCII case and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    flat = b" ".join(tokens)
    if len(tokens) <= width:
        digests = [xxhash.xxh64_digest(flat, 42)]
    else:
        starts = [0, *accumulate(len(w) + 1 for w in tokens)]
        digest = xxhash.xxh64_digest
        digests = [digest(flat[a : b - 1], 42) for a, b in zip(starts, starts[width:])]  # noqa: B905
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def print_of(hashes: np.ndarray, words: int = 1) -> tuple[int, ...]:
    """The fingerprint of shingle hashes: ``words`` numbers of 0 to 2**64 - 1."""
    ones = np.zeros((words, 64), np.int64)
    for i in range(0, len(hashes), 1 << 12):
        h = hashes[i : i + (1 << 12)]
        for k in range(words):
            mixed = (_mixed(h, k) if k else h).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones[k] += np.unpackbits(mixed, axis=1).sum(axis=0, dtype=np.int64)
    return tuple(int.from_bytes(row.tobytes(), "big") for row in np.packbits(2 * ones > len(hashes), axis=1))


def fingerprint_words(text: bytes, width: int = 4, words: int = 1) -> tuple[int, ...]:
    """The fingerprint of UTF-8 bytes: ``words`` numbers of 0 to 2**64 - 1."""
    return print_of(shingle_hashes(text, width), words)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit fingerprint of UTF-8 bytes."""
    return fingerprint_words(text, width)[0]


def _fingerprints(width: int, words: int, *more: str):
    names = [*more, "did", "th"]
    prints = ["fp"] if words == 1 else [f"fp{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole)):
            fp = np.array([fingerprint_words(t, width, words) for t in common.octets(batch.column("text"))], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(words))], names=[*names, *prints])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(did, th, fp) of each row."""
    return common.identified(docs).mapInArrow(_fingerprints(width, 1), "did long, th long, fp long")


def _words(rows, layout: Layout) -> np.ndarray:
    """Fingerprints of a batch, one row each, unsigned."""
    return np.stack([rows.column(c).to_numpy().view(np.uint64) for c in layout.columns[: layout.words]], axis=1)


@cache
def _hamming(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Home anchor of each word of a perfect Hamming code, and the distinct homes
    of the words at distance 1 (padded with its own home)."""
    words = np.arange(1 << length)
    syndrome = np.zeros_like(words)
    for i in range(length):
        syndrome ^= np.where(words >> i & 1, i + 1, 0)
    home = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    near = np.sort(np.stack([home[words ^ (1 << i)] for i in range(length)], axis=1), axis=1)
    others = np.where((near == home[:, None]) | (np.diff(near, axis=1, prepend=-1) == 0), -1, near)
    others = -np.sort(-others, axis=1)[:, : (length - 1) // 2]
    return home, np.where(others < 0, home[:, None], others)


def _from_bit(fp: np.ndarray, first: int) -> np.ndarray:
    """Bits ``first`` and on of rows of 64-bit words, 64 at most."""
    word, shift = divmod(first, 64)
    low = fp[:, word] >> np.uint64(shift)
    return low | fp[:, word + 1] << np.uint64(64 - shift) if shift and word + 1 < fp.shape[1] else low


def anchors_of(fp: np.ndarray, layout: Layout = EXACT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor key, at home) of unsigned fingerprints."""
    fp = fp.reshape(len(fp), layout.words)
    index, keys, homes = [], [], []
    n = np.arange(len(fp))
    for shift, coded in layout.parts:
        top = np.int64(shift) << np.int64(40)
        if not coded:
            index.append(n)
            keys.append(_from_bit(fp, shift).astype(np.int64) | top)
            homes.append(np.ones(len(fp), bool))
            continue
        bits = (_from_bit(fp, shift) & np.uint64(0x3FFFFF)).astype(np.int64)
        low, high = bits & 0x7FFF, bits >> 15
        (home_a, near_a), (home_b, near_b) = _hamming(15), _hamming(7)
        own = home_a[low] | home_b[high] << 15
        index.append(n)
        keys.append(own | top)
        homes.append(np.ones(len(fp), bool))
        for other in (near_a[low] | home_b[high][:, None] << 15, home_a[low][:, None] | near_b[high] << 15):
            row, column = np.nonzero(other != own[:, None])
            index.append(row)
            keys.append(other[row, column] | top)
            homes.append(np.zeros(len(row), bool))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def _counted(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(anchors_of(_words(batch, layout), layout)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), common.longs(n)], names=["key", "n"])

    return run


def _replicated(split: dict[int, int], layout: Layout = EXACT):
    """Fingerprints -> (key, part, home, fingerprint).  A crowded anchor has ``split[key]``
    blocks of residents and as many of visitors, residents among them; each pair of blocks
    is one part, so a part holds two blocks and never the whole anchor."""
    crowded = np.array(sorted(split), dtype=np.int64)
    blocks = np.array([split[k] for k in sorted(split)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):  # a row may have many copies
                some_rows = batch.slice(begin, 4096)
                index, keys, home = anchors_of(_words(some_rows, layout), layout)
                n = np.ones(len(keys), np.int64)
                if len(crowded):
                    at = np.minimum(np.searchsorted(crowded, keys), len(crowded) - 1)
                    n = np.where(crowded[at] == keys, blocks[at], 1)
                ident = some_rows.column(layout.columns[-1]).to_numpy()
                own = ((ident[index].view(np.uint64) * np.uint64(_STEP)) >> np.uint64(33)).astype(np.int64) % n
                for resident in (True, False):
                    # a resident's block meets each block of visitors; a visitor's block each of residents
                    some = np.flatnonzero(home if resident else np.ones(len(keys), bool))
                    row = np.repeat(some, n[some])
                    other = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                    part = own[row] * n[row] + other if resident else other * n[row] + own[row]
                    # one copy does for a resident that visits its own part
                    twice = home[row] & (other == own[row]) & (not resident)
                    row, part = row[~twice], part[~twice]
                    prints = [pa.array(some_rows.column(c).to_numpy()[index[row]]) for c in layout.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(part), pa.array(np.full(len(row), resident)), *prints], names=["key", "part", "home", *layout.columns])

    return run


def _compared(layout: Layout):
    """Rows sorted by place -> links (a, b) that connect what is linked at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.by_key(batches, "place"):
            key, home = table.column("place").to_numpy(), table.column("home").to_numpy()
            words = _words(table, layout)
            cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            size = np.diff(cut)
            group = np.repeat(np.arange(len(size)), size)
            residents = np.flatnonzero(home & (size[group] > 1))
            work = np.cumsum(size[group[residents]])
            top, begin = np.arange(len(key)), 0
            while begin < len(residents):
                done = work[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(work, done + _PAIRS, side="right")))
                some = residents[begin:end]
                n = size[group[some]]
                a = np.repeat(some, n)
                b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + cut[group[a]]
                # what is connected by now needs no comparison, so large groups cost little
                apart = np.flatnonzero(top[a] != top[b])
                a, b = a[apart], b[apart]
                far = np.zeros(len(a), np.int64)
                for i in range(layout.words):
                    far += np.bitwise_count(words[a, i] ^ words[b, i])
                    near = np.flatnonzero(far <= layout.bits)
                    a, b, far = a[near], b[near], far[near]
                if len(a):
                    top = forest(top[a], top[b], len(key))[top]
                begin = end
            moved = np.flatnonzero(top != np.arange(len(key)))
            if len(moved):
                node = table.column(layout.columns[-1]).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[top[moved]])], names=["a", "b"])

    return run


def linked_fingerprints(distinct: DataFrame, root: str, crowd: int = 20_000, layout: Layout = EXACT) -> DataFrame:
    """(node, component) over a table of distinct fingerprints (``layout.columns``)."""
    prints = distinct.select(*layout.columns)
    found = None
    for i, own in enumerate(layout.passes()):
        # a pass has 2**20 anchors and 2**15 for each coded part at most, whatever the data
        counts = prints.mapInArrow(_counted(own), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        split = {r["key"]: -(-r["n"] // crowd) for r in counts.where(F.col("n") > crowd).collect()}
        rows = prints.mapInArrow(_replicated(split, own), f"key long, part long, home boolean, {own.schema}")
        # places that fall together by this hash are compared together: more work, no link beyond the bits
        rows = rows.select(F.xxhash64("key", "part").alias("place"), "home", *own.columns)
        links = rows.repartition(F.col("place")).sortWithinPartitions("place").mapInArrow(_compared(own), "a long, b long")
        if own.parts != layout.parts:  # written, so the next pass finds this one's shuffle gone
            links = common.settle(links.distinct(), f"{root}/pass-{i}")
            common.free_shuffles(distinct.sparkSession)
        found = links if found is None else found.unionByName(links)
    return connected(found, root)


def _grouped(prints: DataFrame, root: str) -> DataFrame:
    """(fp, component) of a table of prints (did, fp, ...)."""
    nodes = common.settle(prints.groupBy("fp").agg(F.min("did").alias("did")), f"{root}/nodes")
    groups = linked_fingerprints(nodes, root)
    placed = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "did", F.coalesce("component", "fp").alias("c"))
    least = placed.groupBy("c").agg(F.min("did").alias("component"))
    return placed.join(least, "c").select("fp", "component")


def simhash_groups(docs: DataFrame, width: int = 4) -> DataFrame:
    """(did, th, fp, component) for each row; component is the smallest did
    reachable. See the module for its rules."""
    root = common.scratch(docs.sparkSession, "simhash")
    prints = common.settle(fingerprints(docs, width), f"{root}/prints")
    return prints.join(_grouped(prints, root), "fp")
