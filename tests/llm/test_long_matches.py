import random

import brute
import numpy as np
import pytest
from conftest import LONG, ODD, frame
from pyspark.sql import functions as F

from spanforge.llm import anchors, suffix_dedup
from spanforge.llm.substring_dedup import SubstringIndex, substring_dedup, word_parts


def removed(df):
    r = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    return sorted((tuple(x) for x in r.collect()), key=str)


def kept(df):
    return sorted((tuple(x) for x in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()), key=str)


def test_every_window_has_its_anchor_row_once():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 4000).astype(np.uint64)
    for geo in (anchors.Geometry(20, 5), anchors.Geometry(64, 20)):
        starts, lengths = np.array([0, 1000, 1000]), np.array([1000, 0, 3000])
        found = anchors.find(values, starts, lengths, geo)
        seen = sorted((int(q), s) for q, lo, hi in zip(found["seq"], found["lo"], found["hi"], strict=True) for s in range(lo, hi + 1))
        assert seen == [(0, s) for s in range(1000 - geo.window + 1)] + [(2, s) for s in range(3000 - geo.window + 1)]
        by_window = {}
        for q, lo, hi, pos, key in zip(found["seq"], found["lo"], found["hi"], found["pos"], found["key"], strict=True):
            for s in range(lo, hi + 1):
                at = starts[q] + s
                assert by_window.setdefault(values[at : at + geo.window].tobytes(), (pos - s, key)) == (pos - s, key)


def test_chunks_cover_each_window_start_once():
    geo = anchors.Geometry(20, 5)
    lengths = [5, 0, 19, 20, 1000, 333, 77]
    starts = sorted((i, s) for part in anchors.chunks(lengths, geo, 100) for i, a, b in part for s in range(a, b - geo.window + 1))
    assert starts == [(i, s) for i, n in enumerate(lengths) for s in range(n - geo.window + 1)]


def test_suffix_array_and_offsets():
    texts = [b"banana", b"bandana", b"", b"ban", b"banana\0", b"\xff"]
    rank, lcp = suffix_dedup.suffix_array(texts)
    order = sorted(texts)
    assert [order.index(t) for t in texts] == rank.tolist()

    def common(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    assert lcp.tolist() == [common(x, y) for x, y in zip(order, order[1:], strict=False)]


@pytest.mark.parametrize("dense", [1000, 1])
def test_bytes_against_brute_force(documents, dense):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert removed(suffix_dedup.suffix_dedup(documents, dense=dense)) == sorted(brute.repeats(rows, 400), key=str)


def test_words_against_brute_force(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert kept(substring_dedup(documents, batches=3)) == sorted(brute.earlier_words(rows, 20), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_passages(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé \n") for _ in range(rng.randint(100, 900))) for _ in range(6)]
    rows = []
    for i in range(40):
        text = "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(200)) for _ in range(5))
        rows.append((i, text[rng.randint(0, 50) :], "en", "a"))
    df = frame(spark, rows)
    pairs = [r[:2] for r in rows]
    assert removed(suffix_dedup.suffix_dedup(df)) == sorted(brute.repeats(pairs, 400), key=str)
    assert removed(suffix_dedup.suffix_dedup(df, dense=1)) == sorted(brute.repeats(pairs, 400), key=str)
    assert removed(suffix_dedup.suffix_dedup(df, window=90)) == sorted(brute.repeats(pairs, 90), key=str)
    assert kept(substring_dedup(df)) == sorted(brute.earlier_words(pairs, 20), key=str)
    assert kept(substring_dedup(df, window=7)) == sorted(brute.earlier_words(pairs, 7), key=str)


def test_odd_rows(odd, empty):
    assert removed(suffix_dedup.suffix_dedup(odd)) == sorted(brute.repeats([r[:2] for r in ODD], 400), key=str)
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup(odd).collect()}
    n = len(LONG.split())
    assert got[7, n] < n  # the earliest keeps its first occurrences
    assert got[12, n] == n
    assert got[1, 0] == got[2, 0] == got[10, 0] == 0
    assert substring_dedup(odd).count() == len(ODD)
    assert suffix_dedup.suffix_dedup(empty).count() == substring_dedup(empty).count() == 0


def test_text_less_repeats_keeps_rows_and_columns(odd):
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    texts = {r.doc_id: r.text for r in out.where("doc_id in (1, 3, 8)").collect()}
    assert texts[1] is None and texts[3] == "one two" and texts[8] == "Intro.coda of its own"


def test_batches_one_after_another_equal_one_run(spark, documents, tmp_path, fanout=2):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    cuts = sorted(r[0] for r in rows)[:: len(rows) // 4][1:]
    parts = [documents.where(F.col("doc_id").between(a, b - 1)) for a, b in zip([-1, *cuts], [*cuts, 10**9], strict=True)]
    for k, part in enumerate(parts):  # opened anew for each batch
        suffix_dedup.SuffixIndex(spark, str(tmp_path / "bytes"), fanout=fanout).add(part)
        SubstringIndex(spark, str(tmp_path / "words"), fanout=fanout).add(part)
        known = part if not k else known.unionByName(part)
    index = SubstringIndex(spark, str(tmp_path / "words"), fanout=fanout)
    assert index.state["batches"] == len(parts) and sum(len(x) for x in index.state["levels"]) < len(parts)
    assert kept(index.cuts()) == sorted(brute.earlier_words(rows, 20), key=str)
    assert removed(suffix_dedup.SuffixIndex(spark, str(tmp_path / "bytes")).cuts()) == sorted(brute.repeats(rows, 400), key=str)


def test_many_repeated_rows_without_an_id(spark):
    same = " ".join(f"w{i}" for i in range(200)) + " "
    rows = [(None, same, "en", "a")] * 4000 + [(None, f"{i} {same}", "en", "a") for i in range(300)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows))
    assert got.where(F.octet_length("kept") > 4).count() == 0 and got.count() == len(rows)
    words = substring_dedup(frame(spark, rows)).groupBy("n_removed").count().collect()
    assert sum(r["count"] for r in words if r.n_removed > 150) == len(rows) - 1


def test_ids_whose_hashes_collide(spark):
    texts = [(None, "plumless " + "a b c d " * 60), (None, "buckeroo " + "d c b a " * 60), (-(2**63), "least " + "a b c d " * 60), (None, None)]
    got = suffix_dedup.suffix_dedup(frame(spark, [(i, t, "en", "a") for i, t in texts]))
    assert removed(got) == sorted(brute.repeats(texts, 400), key=str)


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(4)
    words = [f"{rng.getrandbits(24):x}" for _ in range(200_000)]
    long, part = " ".join(words), " ".join(words[150_000:150_400])
    rows = [(1, long, "en", "a"), (2, f"before {part} after", "en", "a"), (3, None, "en", "a")]
    assert len(long) > 1 << 20
    cut = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert bytes(cut[2].kept) == b"before after" or len(cut[2].kept) <= len("before  after")
    assert len(long) - len(cut[1].kept) >= len(part)
    back = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert back[1].n_removed == 0 and back[1].n_words == 200_000 and bytes(back[1].kept).decode() == long
    assert bytes(back[2].kept) == b"before after"


def test_word_parts_overlap():
    text = b" ".join(b"%d" % i for i in range(5000))
    for overlap in (0, 19, 40):
        seen = {}
        for first, words in word_parts(text, overlap, 500):
            for i, w in enumerate(words, first):
                assert seen.setdefault(i, w) == w == b"%d" % i
        assert len(seen) == 5000


def test_clashing_columns_stay(odd):
    more = odd.withColumns({c: F.lit(c) for c in ("rid", "row", "kept", "spans", "starts", "n_bytes", "lo", "hi", "_d", "_t", "_did", "_th", "_kept")})
    out = suffix_dedup.without_repeats(more)
    assert out.columns == more.columns and {r.kept for r in out.collect()} == {"kept"} and {r._d for r in out.collect()} == {"_d"}


def test_offsets_of_large_groups_equal_pairwise_ones():
    rng = random.Random(6)
    for _ in range(40):
        texts = {"".join(rng.choice("ab") for _ in range(rng.randint(12, 30))).encode() for _ in range(rng.randint(2, 60))}
        parts = [(t[: (a := rng.randint(0, 9))][::-1], t[a:]) for t in sorted(texts)]
        left, right = [x for x, _ in parts], [y for _, y in parts]

        def offsets(found):
            return sorted((i, o) for i, x, y in found for o in range(x, y + 1))

        want = []
        for i, (x, y) in enumerate(parts):
            for o in range(len(x) + 1):
                if len(y) >= 12 - o and any(j != i and p[:o] == x[:o] and len(p) >= o and q[: 12 - o] == y[: 12 - o] for j, (p, q) in enumerate(parts)):
                    want.append((i, o))
        assert offsets(suffix_dedup._by_offset(left, right, 12)) == offsets(suffix_dedup.repeated_offsets(left, right, 12)) == want


class Stopped(RuntimeError):
    pass


def _stops_at(monkeypatch, owner, name, after=0):
    """``owner.name`` fails from its call ``after`` on."""
    own, calls = getattr(owner, name), []

    def dies(*a, **b):
        calls.append(1)
        if len(calls) > after:
            raise Stopped(name)
        return own(*a, **b)

    monkeypatch.setattr(owner, name, dies)


STEPS = [("numbered", "common"), ("free_shuffles", "common"), ("_frequent", "index"), ("_detail", "index"), ("_commit", "index"), ("rename", "store"), ("drop", "common")]


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_a_stopped_add_leaves_the_index_whole(spark, documents, tmp_path, monkeypatch, kind):
    """A batch that merges levels is stopped at every step, the index opened anew, and the
    batch added again; others are stopped once."""
    from spanforge.llm import common

    made = suffix_dedup.SuffixIndex if kind == "bytes" else SubstringIndex
    some = documents.where("doc_id < 90")
    rows = [tuple(r) for r in some.select("doc_id", "text").collect()]
    cuts = sorted(r[0] for r in rows)[:: len(rows) // 4][1:4]
    parts = [some.where(F.col("doc_id").between(a, b - 1)) for a, b in zip([-1, *cuts], [*cuts, 10**9], strict=True)]
    root, stops = str(tmp_path / "index"), 0
    for k, part in enumerate(parts):
        for name, where in (STEPS if kind == "bytes" else STEPS[::3]) if k == 2 else STEPS[3 * k : 3 * k + 1] if k < 2 else ():
            index = made(spark, root)
            before = index.state["batches"]
            assert before == k
            with monkeypatch.context() as m:
                if where == "store":
                    m.setattr(index, "_commit", lambda state, own=index: (_ for _ in ()).throw(Stopped("rename")))
                else:
                    # the first drops sweep up; a later one retires old runs, when the manifest stands already
                    _stops_at(m, common if where == "common" else index, name, after=9 if name == "drop" else 0)
                try:
                    index.add(part)
                except Stopped:
                    stops += 1
            if made(spark, root).state["batches"] > k:  # it stopped after the new state was in place
                break
        else:
            made(spark, root).add(part)
        assert made(spark, root).state["batches"] == k + 1
    index = made(spark, root)
    assert stops >= (8 if kind == "bytes" else 4) and any(index.state["levels"][1:])  # levels were merged on the way
    if kind == "bytes":
        assert removed(index.cuts()) == sorted(brute.repeats(rows, 400), key=str)
    else:
        assert kept(index.cuts()) == sorted(brute.earlier_words(rows, 20), key=str)
    index.finish()
    assert made(spark, root).state["levels"] == []


def test_the_query_merges_levels(documents):
    index = suffix_dedup._indexed(documents, 400, 3, 2, 20_000, finish=False)
    assert index.state["batches"] == 3 and [len(x) for x in index.state["levels"]] == [1, 1]
