import hashlib
import math
import random

import numpy as np
import pytest

from spanforge.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ids int"


def plain(rows, parts=16, size=64, rounds=2):
    """The contract with Python integers, vector by vector."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return set()
    longest = max(len(v) for _, v, _ in kept)
    width = -(-max(1, longest) // parts)
    ints = [[math.floor(256 * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, list(kept[k][1])))[:size]
    books = [[ints[k][p * width : (p + 1) * width] for k in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            members = [[] for _ in books[p]]
            for x in ints:
                part = x[p * width : (p + 1) * width]
                members[nearest(p, part)[1]].append(part)
            fresh.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)])
        books = fresh
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), x in zip(kept, ints, strict=True):
        best = [nearest(p, x[p * width : (p + 1) * width]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def found(df, **how):
    return sorted((tuple(r) for r in vc.vector_codes(df, **how).collect()), key=str)


def test_equals_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").limit(90)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")) == plain(rows)


ODD = [
    (1, None, 1), (2, [], 1), (3, [1.0, None], 2), (4, [float("nan"), 1.0], 2), (5, [float("inf")], None),
    (6, [0.5, -0.25, 0.125], None), (6, [0.5, -0.25, 0.125], None), (6, [-1.0, 2.0], 1), (None, [0.001] * 20, None),
    (7, [-0.001] * 17, 3), (8, [0.0] * 16, 3), (9, [100.0, -100.0], 3),
]


@pytest.mark.parametrize("size,rounds", [(64, 2), (3, 2), (2, 0)])
def test_odd_rows(spark, size, rounds):
    df = spark.createDataFrame([(*r, "x", 7) for r in ODD], SCHEMA).repartition(3)
    assert found(df, size=size, rounds=rounds) == plain(ODD, size=size, rounds=rounds)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1, "", 0)]):
        out = vc.vector_codes(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert out.collect() == []


def test_huge_components_stay_in_range(spark):
    df = spark.createDataFrame([(1, [3e38] * 64, 1, "", 0), (2, [-3e38] * 64, 1, "", 0), (3, [0.0] * 64, 2, "", 0)], SCHEMA)
    assert all(e >= 0 for _, _, e, _, _ in found(df, size=1))


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(32)], draw.choice([None, 1, 2]), "", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = found(df.coalesce(1))
    monkeypatch.setattr(vc, "_BLOCK_BYTES", 2000)
    assert found(df.repartition(7)) == whole


def test_nearest_takes_the_lower_index_of_ties():
    index, distance = vc.nearest(np.array([[0, 5]]), np.array([[1], [-1], [1]]))
    assert index.tolist() == [0, 0] and distance.tolist() == [1, 16]
