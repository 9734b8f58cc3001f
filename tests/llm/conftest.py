import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = f"{HERE.parents[1]}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did long, th int, key string, size int"


@pytest.fixture(scope="session")
def small():
    return os.environ.get("SPANFORGE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


LONG = "".join(f"w{i * i % 977} " for i in range(3000))
#: nulls, empty and long texts, ties, repeated rows, clashing column names
ODD = [
    (1, None, None, None),
    (2, "", "en", "b"),
    (3, "one two", None, "a"),
    (4, "one two", "en", None),
    (4, "one two", "en", None),
    (None, "nothing here but words " * 30, "en", "a"),
    (7, LONG, "en", "b"),
    (8, "Intro. " + LONG[:5000] + " coda of its own", "de", "b"),
    (9, "x" * 3000, "de", "a"),
    (10, " \t\n\v\f\r ", "de", "a"),
    (11, "é" * 500 + " ünïcödé \U0001f600 " + "é" * 500, "fr", ""),
    (12, LONG, "en", "c"),
    (12, "another text of the same id", "en", "c"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 5, 6, "k", 7) for r in rows], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
