import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spanforge.llm import common, variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs):
    """The contract, word by word."""
    lower = str.maketrans(variants.UPPER, variants.LOWER)
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    shapes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shapes[w[:i] + "*" + w[i + 1 :]].add(w)
            shapes[w[:i] + w[i + 1 :]].add(w)
        shapes[w].add(w)
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            near[w] |= shapes[w[:i] + "*" + w[i + 1 :]] | shapes.get(w[:i] + w[i + 1 :], set())
        near[w] |= shapes[w]
        near[w] = {x for x in near[w] if one_edit(w, x)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_near_pairs_equal_all_pairs(seed):
    draw = random.Random(seed)
    m = draw.randint(1, 6)
    entries = sorted({"".join(draw.choice("abc"[: draw.randint(1, 3)]) for _ in range(m - draw.randint(0, 1))) for _ in range(60)})
    found = [tuple(sorted(p)) for p in variants.near_pairs(entries, m)]
    expected = {(i, j) for i in range(len(entries)) for j in range(i) if one_edit(entries[i], entries[j]) and m in (len(entries[i]), len(entries[j]))}
    assert len(found) == len(set(found))
    assert set(found) == {tuple(sorted(p)) for p in expected}


def test_equals_brute_force_on_documents(documents):
    rows = documents.select("doc_id", "text")
    found = variants.spelling_variants(documents).collect()
    assert len(found) > 100
    assert len(found) == len({r["word"] for r in found})
    assert {tuple(r) for r in found} == plain(rows.collect())


def dense(seed=5):
    """Words over two letters, so that groups are large and runs of one letter many."""
    draw = random.Random(seed)
    vocabulary = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(5, 9))) for _ in range(500)})
    return [(i, " ".join(draw.choice(vocabulary) for _ in range(2000))) for i in range(4)]


@pytest.mark.parametrize("limit", [3, 20000])
def test_small_groups_find_the_same(spark, limit):
    docs = spark.createDataFrame(dense(), "doc_id long, text string")
    assert {tuple(r) for r in variants.spelling_variants(docs, limit).collect()} == plain(dense())


def test_groups_are_bounded(spark):
    vocab = variants.vocabulary(spark.createDataFrame(dense(), "doc_id long, text string"))
    rows = variants.groups(vocab, common.scratch(spark, "groups"), 3)
    sizes = rows.groupBy("key").agg({"*": "count", "b": "max", "a": "max"}).collect()
    assert all(r["count(1)"] <= 3 or r["max(b)"] - r["max(a)"] == 1 for r in sizes)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in variants.spelling_variants(odd).collect()} == plain(rows)
    assert variants.spelling_variants(empty).collect() == []


def test_long_text_and_chain_of_forms(spark):
    text = "color " * 9 + "colour " * 40 + "colours " * 100 + "ÉCOLE école École " * 50_000
    docs = [(1, text), (2, None), (2, ""), (None, "color colour")]
    found = {tuple(r) for r in variants.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == plain(docs)
    assert {r[0]: r[2] for r in found}["color"] == "colours"
