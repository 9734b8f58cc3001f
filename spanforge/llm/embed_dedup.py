"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned into the principal axes of the corpus,
the strongest first (an orthogonal map, so cosines stay).  Equal vectors are one
row with a multiplicity.  Rows are cut into tiles by a k-d tree over the leading
axes.  Two vectors of cosine c are ``sqrt(2 - 2c)`` apart, so tiles whose boxes
lie farther apart than the threshold allows are never compared.  In a pair of
tiles the leading axes are multiplied first, and then more of them in steps that double;
at each step the rest of a product is at most the product of the two suffix norms
(Cauchy-Schwarz), and pairs that cannot reach the threshold stop there.  Cosines within
1e-9 of the threshold are computed anew from the vectors as given, which are fetched for
those pairs only.  A pair of tiles gives out link counts and a spanning forest, not its pairs.

The axes are fitted on sums over all rows (a d x d matrix), the tree on a bounded
sample of ``sample`` rows; both only steer the work, and the result does not
depend on them.  Tiles that turn out too large are cut by a hash.

Defined results: vectors that are null, empty, zero or hold a null or a non-finite
component link with nothing and are their own component; shorter vectors are
filled up with zeros; a null vec_id counts as the smallest id; repeated rows are
rows of their own, linked if their vector is sound; an empty table gives an empty
result; labels and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected, forest

_BOX = 8  # leading axes that tiles are cut and kept apart by
_CLOSE = 1e-9


def _unit(batch: pa.RecordBatch, d: int) -> np.ndarray:
    lists = batch.column("v")
    out = np.zeros((len(lists), d))
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat[offsets[0] : offsets[-1]]
    top = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(top > 0, top, 1)  # no overflow, no underflow of squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch, d)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], type=pa.list_(pa.float64()))], names=["m"])

    return run


def _tree(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """k-d tree as nodes (axis, cut, left, right); a leaf is (-1, 0, its number, 0)."""
    nodes: list = []
    count = 0

    def grow(index: np.ndarray, want: int) -> int:
        nonlocal count
        me = len(nodes)
        nodes.append(None)
        if want > 1 and len(index) > 1:
            spread = np.ptp(points[index], axis=0)
            axis = int(spread.argmax())
            cut = float(np.median(points[index, axis]))
            left = points[index, axis] < cut
            if left.any() and not left.all():
                nodes[me] = (axis, cut, grow(index[left], want // 2), grow(index[~left], want - want // 2))
                return me
        nodes[me] = (-1, 0.0, count, 0)
        count += 1
        return me

    grow(np.arange(len(points)), leaves)
    return nodes


def _leaf_of(nodes, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, index = todo.pop()
        axis, cut, left, right = nodes[node]
        if axis < 0:
            out[index] = left
        elif len(index):
            low = x[index, axis] < cut
            todo += [(left, index[low]), (right, index[~low])]
    return out


def _turned(axes: np.ndarray, nodes, d: int):
    """(c, n, v) -> (tile, c, n, x): x the turned unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch, d) @ axes
            tile = _leaf_of(nodes, x[:, :_BOX])
            yield pa.RecordBatch.from_arrays([pa.array(tile), batch.column("c"), batch.column("n"), pa.array(list(x), type=pa.list_(pa.float64()))], names=["tile", "c", "n", "x"])

    return run


def _near_tiles(boxes: list, threshold: float) -> list[tuple[int, int]]:
    """Pairs of tiles whose boxes come within the threshold's distance."""
    low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
    tile = np.array([b["tile"] for b in boxes])
    out = []
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i]))
        near = np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * threshold + 1e-9)
        out += [(int(tile[i]), int(tile[i + j])) for j in near]
    return out


def stops(d: int, lead: int) -> list[int]:
    """Numbers of leading axes after which pairs are looked at: ``lead``, doubled, ..., all."""
    out = [min(max(lead, 1), d)]
    while out[-1] < d:
        out.append(min(2 * out[-1], d))
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of rows whose cosine is not surely below the threshold, and whether it is
    surely at least that. At each stop a pair goes whose product so far and the product of
    its suffix norms cannot reach the threshold; the rest is multiplied for pairs that stay
    only, one by one once they are few."""
    a = b = value = None
    done, part = 0, np.zeros((len(x), len(y)))
    for stop in stops(x.shape[1], lead):
        if a is None or len(a) * 16 > part.size:  # many are left: go on with all of them
            part += x[:, done:stop] @ y[:, done:stop].T
            value = part.ravel() if a is None else part[a, b]
        else:
            for i in range(0, len(a), 1 << 18):
                s = slice(i, i + (1 << 18))
                value[s] += np.einsum("ij,ij->i", x[a[s], done:stop], y[b[s], done:stop])
        rest_x, rest_y = np.linalg.norm(x[:, stop:], axis=1), np.linalg.norm(y[:, stop:], axis=1)
        if a is None:
            a, b = np.nonzero(part + np.outer(rest_x, rest_y) >= threshold - _CLOSE)
            value = part[a, b]
        else:
            stays = value + rest_x[a] * rest_y[b] >= threshold - _CLOSE
            a, b, value = a[stays], b[stays], value[stays]
        done = stop
        if not len(a):
            break
    return a, b, value >= threshold + _CLOSE


def _compare(threshold: float, lead: int, block: int = 2048):
    """Rows of one pair of tiles -> per row its links there, forest links, and the pairs too
    close to the threshold to tell (links is then the weight of ``to``)."""
    schema = pa.schema([("c", pa.int64()), ("links", pa.int64()), ("to", pa.int64()), ("unsure", pa.bool_())])

    def run(group: pa.Table) -> pa.Table:
        side, c, n = (group.column(k).to_numpy() for k in ("side", "c", "n"))
        x = group.column("x").combine_chunks()
        x = x.values.to_numpy().reshape(len(c), -1) if len(c) else np.zeros((0, 1))
        first, second = np.flatnonzero(side < 2), np.flatnonzero((side == 0) | (side == 2))
        same = bool((side == 0).all())
        links, left, right, open_ = np.zeros(len(c), np.int64), [], [], []
        for i in range(0, len(first), block):
            for j in range(i if same else 0, len(second), block):
                p, q = first[i : i + block], second[j : j + block]
                a, b, sure = linked(x[p], x[q], threshold, lead)
                a, b = p[a], q[b]
                if same:
                    up = a < b
                    a, b, sure = a[up], b[up], sure[up]
                open_.append(np.stack([a[~sure], b[~sure]], axis=1))
                a, b = a[sure], b[sure]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                top = forest(a, b, len(c))
                moved = np.flatnonzero(top != np.arange(len(c)))
                left.append(moved)
                right.append(top[moved])
        at = np.flatnonzero(links)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
        u = np.concatenate(open_) if open_ else np.zeros((0, 2), np.int64)
        u = np.concatenate([u, u[:, ::-1]])
        kind = np.repeat([False, True], [len(at) + len(a), len(u)])
        return pa.table({"c": np.concatenate([c[at], c[a], c[u[:, 0]]]), "links": np.concatenate([links[at], np.zeros(len(a), np.int64), n[u[:, 1]]]), "to": np.concatenate([c[at], c[b], c[u[:, 1]]]), "unsure": kind}, schema=schema)

    return run


def _settled(threshold: float):
    """Pairs too close to tell, with their vectors as given -> those that are linked."""
    schema = pa.schema([("c", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column("v").to_pylist(), batch.column("w").to_pylist(), strict=True):
                n = max(len(p), len(q))
                p, q = (np.pad(np.array(z, float), (0, n - len(z))) / np.abs(z).max() for z in (p, q))
                good.append(bool(p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= threshold))
            some = batch.select(["c", "links", "to"]).filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(some.columns, schema=schema)

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, column: str = "embedding", key: str = "vec_id", tile: int = 4096, lead: int = 8, sample: int = 100_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row. See the module for its rules."""
    spark = vectors.sparkSession
    root = common.scratch(spark, "embeddings")
    v = F.transform(vectors[column], lambda e: e.cast("double"))
    rows = vectors.select(F.coalesce(vectors[key].cast("long"), F.lit(common.NO_ID).cast("long")).alias("did"), v.alias("v"))
    finite = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    sound = F.coalesce(finite & F.exists("v", lambda e: e != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    rows = common.settle(rows.select("did", F.when(sound, F.transform("v", lambda e: e + F.lit(0.0))).alias("v")), f"{root}/rows")
    good = rows.where("v is not null")
    distinct = good.groupBy("v").agg(F.min("did").alias("c"), F.count(F.lit(1)).alias("n"))
    # rows of one id may differ in their vector: a class is named by its number
    classes = common.settle(distinct.select("v", F.col("c").alias("least"), "n", F.xxhash64("v", "c").alias("c")), f"{root}/classes")
    total, d = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return rows.select(common.doc_id_back().alias("vec_id"), F.lit(0).cast("long").alias("n_links"), common.doc_id_back().alias("component_id"), F.lit(True).alias("kept"))
    sums = classes.select("v").mapInArrow(_moments(d), "m array<double>")
    parts = sums.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s"))
    gram = np.zeros(d * d)
    for r in parts.collect():  # d * d numbers, whatever the data
        gram[r["pos"]] = r["s"]
    power, axes = np.linalg.eigh(gram.reshape(d, d))
    axes = axes[:, np.argsort(-power)]
    some = classes.select("v", "c").where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total))).drop("c")
    points = [r["v"] for r in some.collect()]  # about ``sample`` rows steer the tiles
    points = np.array([np.pad(p, (0, d - len(p))) / np.abs(p).max() for p in points]).reshape(len(points), d)
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300) @ axes[:, :_BOX]
    nodes = _tree(points, max(1, round(total / tile)))
    turned = classes.select("c", "n", "v").mapInArrow(_turned(axes, nodes, d), "tile long, c long, n long, x array<double>")
    turned = common.settle(turned, f"{root}/turned")
    crowd = {r["tile"]: -(-r["n"] // (2 * tile)) for r in turned.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * tile).collect()}
    if crowd:  # a leaf that the sample misjudged is dealt out
        sizes = spark.createDataFrame(sorted(crowd.items()), "tile long, parts long")
        turned = turned.join(sizes, "tile", "left").withColumn("tile", F.col("tile") * (1 << 20) + F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1)))).drop("parts")
    bounds = [f(F.col("x")[i]) for f in (F.min, F.max) for i in range(min(_BOX, d))]
    b = min(_BOX, d)
    boxes = turned.groupBy("tile").agg(F.array(*bounds[:b]).alias("low"), F.array(*bounds[b:]).alias("high")).orderBy("tile").collect()
    pairs = _near_tiles(boxes, threshold)
    visits = [(p, i, *((a, 0) if a == z else (t, s))) for i, (a, z) in enumerate(pairs) for p, (t, s) in [(0, (a, 1)), (1, (z, 2))] if not (a == z and p)]
    visits = spark.createDataFrame([(t, i, s) for _, i, t, s in visits], "tile long, pair long, side int")
    met = turned.join(visits, "tile").select("pair", "side", "c", "n", "x")
    found = met.groupBy("pair").applyInArrow(_compare(threshold, min(lead, d)), "c long, links long, to long, unsure boolean")
    found = common.settle(found, f"{root}/found")
    close = found.where("unsure").drop("unsure").join(classes.select("c", "v"), "c").join(classes.select(F.col("c").alias("to"), F.col("v").alias("w")), "to")
    close = common.settle(close.select("c", "links", "to", "v", "w").mapInArrow(_settled(threshold), "c long, links long, to long"), f"{root}/close")
    found = found.where("not unsure").drop("unsure").unionByName(close)
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    groups = connected(found.where("c <> to").select(F.col("c").alias("a"), F.col("to").alias("b")), root)
    named = classes.join(counts, "c", "left").join(groups.withColumnRenamed("node", "c"), "c", "left")
    named = named.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "c").alias("g"))
    least = named.groupBy("g").agg(F.min("least").alias("component"))
    named = named.join(least, "g").select("v", "n_links", "component")
    out = rows.join(named, "v", "left").select("did", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "did").alias("component"))
    return out.select(common.doc_id_back().alias("vec_id"), "n_links", common.doc_id_back("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))
