from __future__ import annotations

import datetime as dt

from palimpsest.streaming import ingest


def test_sessions_and_duplicates(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    turns = [(1, 0, "user", "a", at(0)), (1, 0, "user", "a", at(0)), (1, 1, "assistant", "b", at(5)), (2, 0, "user", "c", at(1)), (1, 2, "user", "late day", dt.datetime(2024, 1, 9))]
    spark.createDataFrame(turns, ingest.TURNS).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    jobs = ingest.session_jobs(ingest.unique_turns(ingest.read_turns(spark, f"{tmp_path}/in")))
    q = ingest.start(jobs, lambda df, _: got.extend(df.collect()), f"{tmp_path}/state")
    q.awaitTermination(120)
    assert {(r.conv_id, r.raw_prompt) for r in got} >= {(1, "User: a\nAssistant: b"), (2, "User: c")}
