from collections import Counter

import brute
from pyspark.sql import functions as F
from test_operators import check_one_of_each, water

import corpus_pipeline
from spanforge.llm import queries


def test_stages_against_plain_versions(spark, small, documents, tmp_path):
    from tokenizers import Tokenizer

    docs, seen = documents, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == documents.columns
        seen.append(docs)
    known, single, cut, mixed, packed = seen

    before = {r.doc_id: r for r in documents.collect()}
    after = {r.doc_id: r for r in known.collect()}
    assert all(any(c.isalpha() for c in r.text) for r in after.values())
    assert len(after) >= 0.97 * sum(any(c.isalpha() for c in r.text) for r in before.values())

    check_one_of_each({i: r.text for i, r in after.items()}, [r.doc_id for r in single.collect()])

    pairs = [(r.doc_id, r.text) for r in single.collect()]
    plain = brute.repeats(pairs, 400)
    gone, spans = {r[0]: r[2] for r in plain}, {r[0]: r[3] for r in plain}
    size = {r.doc_id: len(r.text.encode()) for r in cut.collect()}
    full = {i: len(t.encode()) for i, t in pairs}
    assert size.keys() == full.keys()
    assert all(0 <= full[i] - gone[i] - size[i] <= 6 * spans[i] for i in full)  # a character cut in two goes too

    words = Counter()
    for r in cut.collect():
        words[r.source] += len(brute.WORD.findall(r.text))
    want = water(words, 1.5 * sum(words.values()))
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len(brute.WORD.findall(r.text))
    assert all(abs(got[s] - want[s]) <= 0.5 for s in words)

    once = mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"), F.max("text").alias("most"))
    whole = [(r.doc_id, r.text) for r in once.where("n = 1").collect()]
    ids = {i for i, _ in whole}
    assert packed.where(F.col("piece") == 0).count() == mixed.count()
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    tok = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    own = [r for r in packed.collect() if r.doc_id in ids]
    assert sum(r.length for r in own) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in whole)


def test_scratch_of_written_steps_goes(spark, odd, tmp_path):
    from pathlib import Path

    from spanforge.llm import common, similar

    scratch = common.Scratch()
    first = scratch.step(odd, similar.one_of_each)
    made = list(scratch.left)
    assert made and all(Path(p).exists() for p in made)
    again = scratch.step(first, lambda rows: rows)  # not written: its input stays
    assert again.count() == first.count() and all(Path(p).exists() for p in made if p in scratch.left) and scratch.left
    first.write.parquet(str(tmp_path / "first"))
    scratch.step(spark.read.parquet(str(tmp_path / "first")), lambda rows: rows)
    assert not any(Path(p).exists() for p in made) and scratch.left == []


def _run(spark, docs, small, folder):
    counts, columns = [], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    return counts, docs


def test_all_stages_on_odd_rows_and_an_empty_table(spark, odd, empty, documents, small, tmp_path):
    some = documents.select(*[c for c in odd.columns if c in documents.columns]).where("doc_id >= 20")
    counts, packed = _run(spark, odd.unionByName(some, allowMissingColumns=True), small, tmp_path / "odd")
    assert counts[0] >= counts[1] == counts[2] and counts[3] > 0
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids and 2 not in ids and 10 not in ids  # texts without a letter went
    counts, _ = _run(spark, odd, small, tmp_path / "only odd")
    assert len(counts) == 5
    counts, packed = _run(spark, empty, small, tmp_path / "empty")
    assert counts == [0] * 5 and packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
