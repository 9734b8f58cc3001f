import os
import signal
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanforge.operators import counting, evals
from spanforge.sources import model, sessions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
WORK = "key string, prompt string, media array<string>"


class Counting:
    """Fails on any batch that holds a prompt with 'bad' in it."""

    def __init__(self):
        self.calls: list[int] = []

    def ask_many(self, items):
        self.calls.append(len(items))
        if any("bad" in p for p, _ in items):
            raise RuntimeError("no")
        return [p.upper() for p, _ in items]


@pytest.mark.parametrize("n,bad", [(1, 0), (16, 5), (64, 63), (64, None)])
def test_a_failing_batch_is_halved(n, bad):
    client = Counting()
    items = [(f"p{i}" if i != bad else "bad", []) for i in range(n)]
    got = model.asked(client, items)
    assert [g[0] for g in got] == [None if i == bad else f"P{i}" for i in range(n)]
    assert [g[1] is None for g in got] == [i != bad for i in range(n)]
    assert len(client.calls) <= 1 + 2 * np.log2(n) if bad is not None else len(client.calls) == 1


def test_a_short_reply_is_a_failure():
    class Short:
        def ask_many(self, items):
            return [p for p, _ in items][: max(1, len(items) - 1)]

    assert [g[0] for g in model.asked(Short(), [(str(i), []) for i in range(5)])] == list("01234")


def test_bins_are_bounded_both_ways():
    rows = [{"prompt": "x" * n, "media": None} for n in (10, 10, 10, 95, 10, 60, 50, 1, 1, 1)]
    sizes = [[len(r["prompt"]) for r in b] for b in model.batches_of(iter(rows), 3, 100)]
    assert sizes == [[10, 10, 10], [95], [10, 60], [50, 1, 1], [1]]


def test_batched_stage_answers_all_but_the_bad(spark):
    rows = [(str(i), "bad" if i % 37 == 0 else None if i % 50 == 1 else f"p{i}", ["m"] if i % 2 else None) for i in range(300)]
    got = {r.key: r for r in model.batched_stage(spark.createDataFrame(rows, WORK).repartition(3), Counting, most=16).collect()}
    assert len(got) == 300
    for key, prompt, _ in rows:
        want = ("no prompt",) if prompt is None else ("RuntimeError: no",) if prompt == "bad" else (None,)
        assert (got[key].error,) == want and got[key].raw == (prompt.upper() if want == (None,) else None)


class Loaded:
    """Notes each load and each close in a file of its process."""

    def __init__(self, folder):
        self.note = Path(folder, str(os.getpid()))
        self.note.open("a").write("load\n")

    def ask(self, prompt, media):
        return f"{os.getpid()}"

    def close(self):
        self.note.open("a").write("close\n")


def test_one_session_a_worker_process(spark, tmp_path):
    folder = str(tmp_path)
    work = spark.createDataFrame([(str(i), f"p{i}", None) for i in range(64)], WORK).repartition(16)
    client = sessions.session_client(f"one-{folder}", lambda: Loaded(folder), linger=600)
    got = model.model_stage(work, client).collect()
    assert len(got) == 64 and all(r.error is None for r in got)
    notes = [p.read_text() for p in tmp_path.iterdir()]
    assert {r.raw for r in got} == {p.name for p in tmp_path.iterdir()} and all(n == "load\n" for n in notes)  # 16 tasks, a load a process


def test_sessions_close_with_their_last_holder(tmp_path):
    first = sessions.shared("s", lambda: Loaded(tmp_path), linger=0)
    second = sessions.shared("s", lambda: Loaded(tmp_path), linger=0)
    note = Path(tmp_path, str(os.getpid()))
    first.close()
    first.close()  # giving back twice is once
    assert note.read_text() == "load\n" and second.ask("x", [])
    second.close()
    assert note.read_text() == "load\nclose\n"
    with pytest.raises(RuntimeError, match="given back"):
        second.ask("x", [])
    with sessions.shared("s", lambda: Loaded(tmp_path), linger=0.1):
        pass
    assert note.read_text().count("close") == 1
    time.sleep(0.5)
    assert note.read_text() == "load\nclose\n" * 2
    with pytest.raises(ZeroDivisionError):
        sessions.shared("t", lambda: 1 / 0)
    sessions.shared("t", lambda: Loaded(tmp_path), linger=0).close()


SERVER = """
import json, os, sys, time
print("starting", file=sys.stderr)
if "stall" in sys.argv: time.sleep(60)
if "die" in sys.argv: sys.exit(3)
print("noise before"); print("###READY###", flush=True)
for line in sys.stdin:
    ask = json.loads(line) if line.startswith("{") else {"prompt": line.strip(), "media": []}
    print("x" * 200_000, file=sys.stderr)  # more than a pipe holds
    if ask["prompt"] == "crash": os._exit(9)
    if ask["prompt"] == "hang": time.sleep(60)
    print("###CAPTION_START###")
    print("__ERROR__: cannot" if ask["prompt"] == "fail" else ask["prompt"] + "\\nsecond line " + str(os.getpid()))
    print("###CAPTION_END###", flush=True)
"""


def command(tmp_path, *more):
    (tmp_path / "server.py").write_text(SERVER)
    return [sys.executable, str(tmp_path / "server.py"), *more]


def test_line_server(tmp_path):
    server = sessions.LineServer(command(tmp_path), start_timeout=30, reply_timeout=1.5)
    for prompt in ("one", "dos é", "two\nlines"):
        assert server.ask(prompt, ["a", "b"]).split("\n")[0] == prompt.split("\n")[0]
    assert server.ask("", ["clip.wav"]).startswith("clip.wav\nsecond line")
    with pytest.raises(RuntimeError, match="^cannot$"):
        server.ask("fail", ["a", "b"])
    pid = int(server.ask("x", []).split()[-1])
    os.kill(pid, signal.SIGKILL)
    time.sleep(0.2)
    assert int(server.ask("x", []).split()[-1]) != pid and server.starts == 2  # started again
    with pytest.raises(RuntimeError, match="ended with code 9"):
        server.ask("crash", [])
    assert server.ask("x", []) and server.starts == 3
    with pytest.raises(TimeoutError, match="did not reply in time"):
        server.ask("hang", [])
    assert server.ask("x", [])
    server.close()
    server.close()


def test_line_server_that_does_not_start(tmp_path):
    with pytest.raises(TimeoutError, match="not ready in time; its last errors: starting"):
        sessions.LineServer(command(tmp_path, "stall"), start_timeout=1)
    with pytest.raises(RuntimeError, match="ended with code 3"):
        sessions.LineServer(command(tmp_path, "die"), start_timeout=30)


def test_tally_counts_in_the_writing_job(spark, tmp_path):
    rows = spark.range(1000).withColumn("kind", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 3 == 0, "odd").otherwise("ok")))
    kept, tally = counting.split(rows, F.col("kind") == "ok", unknown=F.col("kind").isNull(), odd=F.col("kind") == "odd")
    kept.write.parquet(str(tmp_path / "out"))
    n = {k: sum(1 for i in range(1000) if f(i)) for k, f in {"unknown": lambda i: i % 7 == 0, "odd": lambda i: i % 7 and i % 3 == 0}.items()}
    assert tally.counts() == {"total": 1000, "kept": 1000 - sum(n.values()), "dropped": sum(n.values()), **n}
    assert spark.read.parquet(str(tmp_path / "out")).count() == tally.counts()["kept"]
    assert sorted(tuple(r) for r in tally.table(spark).collect())[0] == ("dropped", sum(n.values()))


def test_each_resample_draws_as_many_rows_as_there_are(spark):
    rows = spark.range(0, 3001, 1, 7).select("id", (F.col("id") % 10).cast("double").alias("x")).unionByName(spark.range(5).select("id", F.lit(None).cast("double").alias("x")))
    got = evals.resamples(rows, "x", "id", draws=400).collect()
    assert sorted(r.rep for r in got) == list(range(400)) and {r.w for r in got} == {3001}
    means = np.array([r.x / r.w for r in got])
    values = np.arange(3001) % 10
    assert abs(means.mean() - values.mean()) < 4 * values.std() / np.sqrt(3001 * 400)
    assert 0.85 < means.std() / (values.std() / np.sqrt(3001)) < 1.15
    assert evals.resamples(rows, "x", "id", draws=400, seed=1).collect() != got


def test_weights_are_multinomial():
    rng = np.random.default_rng(0)
    w = evals._weights(40, np.full(5000, 80), rng)
    assert w.shape == (40, 5000) and (w.sum(axis=0) == 80).all()
    assert np.allclose(w.mean(), 2) and abs(w.var() - 80 * (1 / 40) * (39 / 40)) < 0.05
    bounds = np.array([0, 10, 10, 40, 41])
    shares = np.stack([evals._share(bounds, p, np.full(20_000, 41), 3) for p in range(4)])
    assert (shares.sum(axis=0) == 41).all() and (shares[1] == 0).all()
    assert np.allclose(shares.mean(axis=1), [10, 0, 30, 1], atol=0.1)
    assert abs(np.cov(shares[0], shares[2])[0, 1] + 41 * (10 / 41) * (30 / 41)) < 0.3
