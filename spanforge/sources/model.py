"""Pluggable model calls: the one boundary where rows leave the JVM."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Client(Protocol):
    """Answers prompts in order; may raise."""

    def ask(self, prompt: str, media: list[str]) -> str: ...


class ManyClient(Protocol):
    """Answers a batch of (prompt, media) in order, all of it or none."""

    def ask_many(self, items: list[tuple[str, list[str]]]) -> list[str]: ...


class FakeClient:
    """A pure function of the prompt, for tests."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def ask(self, prompt: str, media: list[str]) -> str:
        return self.answer(prompt)


class HttpClient:
    """A chat-completions server; ``options`` go to the top level of the request."""

    def __init__(self, url: str, model: str, timeout: float = 120, **options):
        self.url, self.model, self.timeout, self.options = url, model, timeout, options

    def ask(self, prompt: str, media: list[str]) -> str:
        content = [{"type": "text", "text": prompt}, *({"type": "video_url", "video_url": {"url": m}} for m in media)]
        body = {"model": self.model, "messages": [{"role": "user", "content": content}], **self.options}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def dealt(work: DataFrame) -> DataFrame:
    """The rows of ``work`` over as many tasks as a shuffle has: calls take long, and tables of
    few bytes hold many of them. A fixed number, as adaptive tasks are measured in bytes."""
    spark = work.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return work.repartition(n, "key")


def retry_delay(attempt: int, most: float = 60) -> float:
    return min(5 * 2 ** (attempt - 1), most)


def model_stage(work: DataFrame, client: Callable[[], Client], attempts: int = 3, threads: int = 4, pause: Callable[[int], float] = retry_delay, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """(key, prompt, media) -> (key, raw, error, attempts). The client is built once a
    task and closed with it if it can be; prompts run in a pool and fail one by one. ``accept`` may ask for another
    draw; the last one stays. Write the result before using it twice: a model need not
    answer alike when a task is run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()

        def one(row) -> tuple:
            error = raw = None
            for k in range(1, attempts + 1):
                try:
                    raw, error = own.ask(row["prompt"], row["media"] or []), None
                    if accept is None or accept(raw):
                        break
                except Exception as problem:  # any failure of a client is a row's own
                    error = f"{type(problem).__name__}: {problem}"
                    if k < attempts:
                        time.sleep(pause(k))
            return row["key"], raw, error, k

        try:
            with ThreadPoolExecutor(threads) as pool:
                for batch in batches:
                    done = list(pool.map(one, batch.select(["key", "prompt", "media"]).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["key", "raw", "error", "attempts"])
        finally:
            close = getattr(own, "close", None)
            if close:
                close()

    return dealt(work.select("key", "prompt", "media")).mapInArrow(run, "key string, raw string, error string, attempts int")


_ANSWERED = pa.schema([("key", pa.string()), ("raw", pa.string()), ("error", pa.string()), ("calls", pa.int32())])


def _size(item: tuple[str, list[str]]) -> int:
    return len(item[0].encode()) + sum(len(m.encode()) for m in item[1])


def asked(client: ManyClient, items: list[tuple[str, list[str]]]) -> list[tuple[str | None, str | None, int]]:
    """(reply, error, calls that it was in) of each item. A batch that fails, or comes back
    with another number of replies, is halved until what fails is alone: a bad item among n
    costs about 2 log2(n) further calls, and no other item its answer."""
    out: list[tuple[str | None, str | None, int]] = [(None, None, 0)] * len(items)
    todo = [(0, len(items), 1)]
    while todo:
        lo, hi, calls = todo.pop()
        try:
            replies = client.ask_many(items[lo:hi])
            if len(replies) != hi - lo:
                raise ValueError(f"{len(replies)} replies to {hi - lo} prompts")
            out[lo:hi] = [(r, None, calls) for r in replies]
        except Exception as problem:  # any failure of a client is its items' own
            if hi - lo == 1:
                out[lo] = (None, f"{type(problem).__name__}: {problem}", calls)
            else:
                mid = (lo + hi) // 2
                todo += [(mid, hi, calls + 1), (lo, mid, calls + 1)]
    return out


def batches_of(rows: Iterator[dict], most: int, most_bytes: int) -> Iterator[list[dict]]:
    """Consecutive rows in bins of at most ``most`` rows and ``most_bytes`` bytes of prompt
    and media names; a row beyond that is a bin of its own."""
    held, size = [], 0
    for row in rows:
        own = _size((row["prompt"], row["media"] or []))
        if held and (len(held) == most or size + own > most_bytes):
            yield held
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield held


def batched_stage(work: DataFrame, client: Callable[[], ManyClient], most: int = 16, most_bytes: int = 1 << 20) -> DataFrame:
    """(key, prompt, media) -> (key, raw, error, calls): prompts are asked in batches bounded
    by number and by bytes, formed within a task whatever batches Arrow brings them in. A
    null prompt is an error and never asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        lost: list[str] = []

        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.select(["key", "prompt", "media"]).to_pylist():
                    if row["prompt"] is None:
                        lost.append(row["key"])
                    else:
                        yield row

        try:
            for bin_ in batches_of(rows(), most, most_bytes):
                got = asked(own, [(r["prompt"], r["media"] or []) for r in bin_])
                columns = [[r["key"] for r in bin_], *zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ANSWERED, strict=True)], schema=_ANSWERED)
            if lost:
                n = len(lost)
                yield pa.RecordBatch.from_arrays([pa.array(lost), pa.nulls(n, pa.string()), pa.array(["no prompt"] * n), pa.array([0] * n, pa.int32())], schema=_ANSWERED)
        finally:
            close = getattr(own, "close", None)
            if close:
                close()

    return work.select("key", "prompt", "media").mapInArrow(run, "key string, raw string, error string, calls int")
