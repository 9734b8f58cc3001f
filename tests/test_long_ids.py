"""Ids of more than six digits: SQL's lpad cuts them to six places, and their order is that of the numbers."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = ["run_round_trip", "runs_merged", "videos_replaced", "review_rows", "stage_outputs", "generation_prompts", "judge_prompt_texts", "verified_by_dimension_fake"]


@pytest.fixture(scope="module")
def long_ids(tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.execute(f"copy (select * replace (event_id + 999700 as event_id, user_id % 9 as user_id) from '{SMALL}/events.parquet') to '{folder}/events.parquet' (format parquet)")
    con.execute(f"copy (from '{SMALL}/conversations.parquet') to '{folder}/conversations.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, long_ids, name):
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"create view {t} as select * from '{long_ids}/{t}.parquet'")
    answer = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    # SQL leaves the order of one id's equal dimensions open
    row = lambda r: repr(tuple(sorted(x.split("; ")) if c == "failure_reason" else x for c, x in zip(names, r, strict=True)))
    want = sorted(map(row, answer.fetchall()))
    assert sorted(map(row, entry.queries()[name](spark, long_ids).select(*names).collect())) == want
