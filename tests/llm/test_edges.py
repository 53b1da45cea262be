"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, media_columns, secret_scan, sentencepiece_codec, suffix_dedup, toxicity

CLASHES = ("key", "cls", "digest", "n", "spans", "comp", "block", "fp", "score", "k1", "gold", "lang_pred", "_k1s", "word")
LONG = "lorem ipsum dolor sit amet " * 60_000  # 1.6 MB
ROWS = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t ", "en", None, 6), (3, "one", "fr", "a", 3), (4, "the same text of seven words here", "en", "a", 33), (5, "the same text of seven words here", None, "b", 33), (6, LONG, "en", "a", len(LONG)), (7, "naïve café 日本語 \u0000 👩‍👩‍👧 ﬁ", "fr", "c", 20), (None, "a row without an id", "en", "a", 19), (8, "x" * 5000, "en", "a", 5000)]
OPERATORS = {
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (4, 0)], "doc_id bigint, toxic int")),
    "language_id": language_id.language_id,
    "sentencepiece": sentencepiece_codec.encode,
    "jaccard": jaccard_join.near_duplicates,
    "media": media_columns.document_media,
    "secrets": secret_scan.secret_scan,
    "lm": lm_scoring.lm_score,
    "suffix": suffix_dedup.suffix_dedup,
    "lines": line_dedup.line_report,
}
PER_ROW = set(OPERATORS)


def make(spark, data):
    d = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHES:
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    got = OPERATORS[name](make(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](make(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_repeated_rows(spark, name):
    data = [ROWS[4], ROWS[4], ROWS[3]]
    got = OPERATORS[name](make(spark, data)).collect()
    assert sorted(r.doc_id for r in got) == [3, 4, 4]


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the same text of seven words here"), (4, "nothing like it at all anywhere in these")], "item_id bigint, text string")
    got = decontamination.decontaminate(make(spark, ROWS), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(4, 3), (5, 3)}
    assert decontamination.decontaminate(make(spark, []), bench).count() == 0
    assert decontamination.decontaminate(make(spark, ROWS), bench.filter("item_id < 3")).count() == 0


def test_whole_rows_stay_in_place(spark):
    d = make(spark, ROWS)
    out = line_dedup.deduplicated(d)
    assert out.columns == d.columns and out.count() == len(ROWS)
    kept = toxicity.accepted(d, toxicity.Scorer())
    assert kept.columns == d.columns


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}", i % 2) for i in range(3000)] + [(-1, None, 0), (-1, None, 0), (-2, "rare", 1)], "i long, k string, salt int")
    right = spark.createDataFrame([("hot", 1, "x"), ("k0", 2, "y"), ("k3", 3, None), ("unused", 4, "z")], "k string, parts int, v string")
    counted = left.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    got = common.spread_join(left, right, ["k"], counted, ["i"], how)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    none = common.spread_join(left.limit(0), right, ["k"], counted.limit(0), ["i"], how)
    assert none.count() == 0
