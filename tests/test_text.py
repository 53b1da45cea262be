from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(("name", "want"), [("Algorithms", "algorithm"), ("Strategies", "strategy"), ("Python", "python"), ("General Sleep", "sleep"), ("stress", "stress"), ("  Big   Data ", "big data"), ("generalist", "generalist")])
def test_normalize_name(spark, name, want):
    assert one(spark, X.normalize_name, name) == want


@pytest.mark.parametrize(("said", "want"), [("Summarize my week", "broad_overview"), ("what port does it use", "information_extraction"), (None, None)])
def test_classify_query(spark, said, want):
    got = one(spark, X.classify_query, said)
    assert got == want or (said is None and got in (None, "information_extraction"))


def test_strip_timestamps(spark):
    assert one(spark, X.strip_timestamps, "Timestamp: March-01-2024\nat 2024-01-02 10:20 or Jan-5-2024 done") == "at  or  done"


@pytest.mark.parametrize(("raw", "want"), [("a\tb", "a b"), ("x = 123456789012345678901", "x = [large_number]"), (r"\frac{1}{2}", "(1/2)"), ("----", ""), ("```python\nx\n```", "x"), ("a\n\n\n\nb", "a\n\nb")])
def test_clean_prompt(spark, raw, want):
    assert one(spark, X.clean_prompt, raw) == want


@pytest.mark.parametrize(("p", "c", "want"), [("General Sleep", "Sleep", "Sleep"), ("Sleep", "General Sleep", "Sleep"), ("Data", "Big Data", "Big Data"), ("Big Data", "Data", "Big Data"), ("Health", "Diet", "Diet")])
def test_better_name(spark, p, c, want):
    assert spark.createDataFrame([(p, c)], "p string, c string").select(X.better_name(F.col("p"), F.col("c"))).first()[0] == want


def test_json_helpers(spark):
    assert one(spark, X.strip_fences, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.collapse_loops, "a\n\n\n\nb\t\t\tc") == "a b c"


def test_unit_of_zero_and_null(spark):
    d = spark.createDataFrame([([0.0, 0.0],), (None,), ([3.0, 4.0],)], "v array<float>").select(X.unit(F.col("v")).alias("v")).collect()
    assert d[0].v == [0.0, 0.0] and d[1].v is None and d[2].v == [0.6000000000000001, 0.8] or d[2].v == [0.6, 0.8]


def test_truncate_and_tokens(spark):
    assert one(spark, lambda t: X.truncate_words(t, 2), " a  b c") == "a b"
    assert one(spark, X.estimate_tokens, "123456789") == 2
