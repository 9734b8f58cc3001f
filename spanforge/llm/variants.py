"""Spelling variants by merging errata tries.

Words that differ by one inserted, deleted or replaced code point are found in tries.
At each node the subtree with most words is the heavy child, and the light subtrees
are merged: with one character replaced into the heavy child's subtree and into the
errata trie of the lights before them (largest first), with one character skipped
into the node's own children.  Terminals that coincide are near words.  A word is in
light subtrees of O(log n) of its ancestors only, so n words take O(n log n) visits
for each character of their length.

A trie must hold words that share all but a window of positions.  Two near words, the
longer of m code points, first differ at one position p.  Class m holds the words of
m and of m - 1 code points; its windows [0, m/2) and [m/2, m) take the words by what
lies outside the window, which near words have in common.  Each word is in four
such groups.  A group of more than ``limit`` words is dealt out again with its window
halved, down to a window of one position, where the alphabet bounds it; so no group
grows with the corpus, and each near pair meets in one group only.  A group gives out
sums for each word, not its pairs.

Defined results: a null text holds no words, a null doc_id is hashed as no characters,
repeated rows count again, no words give an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def words(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word): each run of letters, A-Z lower-cased, one code point less where ``every``
    divides the crc32 of ``<doc_id>:<run>``."""
    runs = docs.select(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(common.text_of(docs), F.lit(RUN), F.lit(0))).alias("run"),
    ).select("d", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    return words(docs).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _key(m: Column, a: Column, b: Column) -> Column:
    """What a word shares with the others of its window: class, window, and its ends."""
    w = F.col("word")
    return F.concat_ws("|", m.cast("string"), a.cast("string"), b.cast("string"), F.substring(w, F.lit(1), a), F.right(w, m - b))


def _placed(rows: DataFrame, windows: Column) -> DataFrame:
    """One row for each of ``windows`` (an array of structs m, a, b)."""
    each = rows.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.m", "w.a", "w.b")
    return each.select("word", "n", "m", "a", "b", _key(F.col("m"), F.col("a"), F.col("b")).alias("key"))


def _halves(m: Column, a: Column, b: Column) -> list[Column]:
    c = F.floor((a + b) / 2).cast("int")
    return [F.struct(m.alias("m"), x.alias("a"), y.alias("b")) for x, y in ((a, c), (c, b))]


def groups(vocab: DataFrame, root: str, limit: int = 20000) -> DataFrame:
    """(word, n, m, a, b, key): the words of each window's group, none of more than
    ``limit`` words unless its window has one position. ``root``: a scratch folder."""
    length = F.char_length("word").cast("int")
    first = F.array(*_halves(length, F.lit(0), length), *_halves(length + 1, F.lit(0), length + 1))
    rows = common.settle(_placed(vocab, first), f"{root}/windows-0")
    done, step = None, 0
    while True:
        large = rows.where("b - a > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("key")
        large = common.settle(large, f"{root}/large-{step}")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        step += 1
        fine = rows.join(large, "key", "left_anti").select(rows.columns)
        done = fine if done is None else done.unionByName(fine)
        split = rows.join(large, "key", "left_semi").select(rows.columns)
        halves = F.array(*_halves(F.col("m"), F.col("a"), F.col("b")))
        rows = common.settle(_placed(split, halves), f"{root}/windows-{step}")


class _Trie:
    """Words character by character; ``end[x]`` is the word that ends at node x, or -1."""

    def __init__(self, entries: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.end = [-1]
        for i, word in enumerate(entries):
            at = 0
            for c in word:
                to = self.kids[at].get(c)
                if to is None:
                    to = self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.end.append(-1)
                at = to
            self.end[at] = i
        self.weight = [int(e >= 0) for e in self.end]
        for x in range(len(self.kids) - 1, -1, -1):  # children come after their parents
            self.weight[x] += sum(self.weight[k] for k in self.kids[x].values())

    def coincide(self, x: int, y: int) -> Iterator[tuple[int, int]]:
        """Words that end at the same place below x and below y."""
        kids, end, todo = self.kids, self.end, [(x, y)]
        while todo:
            x, y = todo.pop()
            if end[x] >= 0 and end[y] >= 0:
                yield end[x], end[y]
            a, b = kids[x], kids[y]
            if len(a) <= len(b):
                todo += [(k, b[c]) for c, k in a.items() if c in b]
            else:
                todo += [(a[c], k) for c, k in b.items() if c in a]

    def merged(self, lights: list[int]) -> Iterator[tuple[int, int]]:
        """Words that coincide among subtrees, found by merging one after another."""
        kids: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        for light in lights:
            todo = [(light, 0)]
            while todo:
                x, y = todo.pop()
                if self.end[x] >= 0:
                    for other in ends[y]:
                        yield self.end[x], other
                    ends[y].append(self.end[x])
                for c, k in self.kids[x].items():
                    to = kids[y].get(c)
                    if to is None:
                        to = kids[y][c] = len(kids)
                        kids.append({})
                        ends.append([])
                    todo.append((k, to))


def near_pairs(entries: list[str], m: int, after: str = "") -> Iterator[tuple[int, int]]:
    """Index pairs of entries one edit apart, the longer of ``m`` code points. Entries are
    distinct, of m or m - 1 code points; two of m - 1 are the next smaller class's. ``after``
    is what follows all of them: a character skipped right before its like is skipped there."""
    trie = _Trie(entries)
    for u, kids in enumerate(trie.kids):
        if trie.weight[u] < 2:
            continue
        # one character replaced
        if len(kids) > 1:
            heavy, *lights = sorted(kids.values(), key=trie.weight.__getitem__, reverse=True)
            for light in lights:
                yield from ((x, y) for x, y in trie.coincide(light, heavy) if len(entries[x]) == m)
            if len(lights) > 1:
                yield from ((x, y) for x, y in trie.merged(lights) if len(entries[x]) == m)
        # one character skipped, the last of equal neighbours
        for c, k in kids.items():
            if c != after[:1] and trie.end[k] >= 0 and trie.end[u] >= 0:
                yield trie.end[k], trie.end[u]
            below = trie.kids[k]
            for d in below if len(below) <= len(kids) else kids:
                if d != c and d in below and d in kids:
                    yield from trie.coincide(below[d], kids[d])


class _Best:
    """For each of some words: how many near words, and the best of them."""

    def __init__(self, all_words: list[str], n: np.ndarray):
        self.n, self.count = n, np.zeros(len(n), np.int64)
        order = sorted(range(len(n)), key=lambda i: (-int(n[i]), all_words[i]))
        self.place = np.empty(len(n), np.int64)
        self.place[order] = np.arange(len(n))
        self.order, self.best = np.asarray(order, np.int64), np.full(len(n), len(n), np.int64)
        self.held: list[tuple[int, int]] = []

    def add(self, x: int, y: int) -> None:
        self.held.append((x, y))
        if len(self.held) >= 1 << 18:
            self.fold()

    def fold(self) -> None:
        if self.held:
            pairs = np.asarray(self.held, np.int64)
            for x, y in (pairs.T, pairs.T[::-1]):
                np.add.at(self.count, x, 1)
                np.minimum.at(self.best, x, self.place[y])
            self.held = []


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in common.by_key(batches):
        keys = table.column("key").to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        entries, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        m, a, b = (table.column(c).to_pylist() for c in ("m", "a", "b"))
        best = _Best(entries, n)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                rest = m[lo] - b[lo]
                after = entries[lo][len(entries[lo]) - rest :]
                for x, y in near_pairs([w[a[lo] : len(w) - rest] for w in entries[lo:hi]], b[lo] - a[lo], after):
                    best.add(lo + x, lo + y)
        best.fold()
        some = np.flatnonzero(best.count)
        if len(some):
            near = best.order[best.best[some]]
            columns = [pa.array([entries[i] for i in some], pa.string()), common.longs(best.count[some]), common.longs(n[near]), pa.array([entries[i] for i in near], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def near_words(vocab: DataFrame, root: str, limit: int = 20000) -> DataFrame:
    """(word, n_near, best_n, best) of each word of ``vocab`` (word, n) that has near words;
    best: the most frequent of them, ties to the smallest in code-point order."""
    rows = groups(vocab, root, limit).select("key", "word", "n", "m", "a", "b")
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "word string, n_near long, best_n long, best string")
    total = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b"))
    return total.select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame, root: str) -> DataFrame:
    """(word, up) with ``up`` followed to its last. Links lead to words at least twice as
    frequent, so chains are short; each round doubles the way followed."""
    links = common.settle(links, f"{root}/ups-0")
    step = 0
    while True:
        step += 1
        further = links.select(F.col("word").alias("up"), F.col("up").alias("next"))
        links = common.settle(links.join(further, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), f"{root}/ups-{step}")
        if links.where("moved").isEmpty():
            return links.select("word", "up")
        links = links.select("word", "up")


def spelling_variants(docs: DataFrame, limit: int = 20000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs``: ``form`` is its most
    frequent near word if that is at least twice as frequent, ``root`` the end of forms."""
    root = common.scratch(docs.sparkSession, "variants")
    vocab = common.settle(vocabulary(docs), f"{root}/vocabulary")
    near = near_words(vocab, root, limit)
    good = F.col("best_n") >= 2 * F.col("n")
    rows = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")
    )
    rows = common.settle(rows, f"{root}/forms")
    ups = roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("up")), root)
    return rows.join(ups, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
