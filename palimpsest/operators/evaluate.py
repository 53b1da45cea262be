"""Evaluation: dataset flattening, answer lookup, verdict parsing and score aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def flatten_sessions(convs: DataFrame) -> DataFrame:
    """(conv_id, session, turn_id, role, content) of nested sessions, the first of equal turn ids kept."""
    s = convs.select("conv_id", F.posexplode("sessions").alias("session", "turns"))
    t = s.select("conv_id", "session", F.posexplode("turns").alias("pos", "t")).select("conv_id", "session", "pos", F.col("t.id").alias("turn_id"), F.col("t.role").alias("role"), F.col("t.content").alias("content"))
    w = Window.partitionBy("conv_id", "turn_id").orderBy("session", "pos")
    return t.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "pos")


def evidence_sessions(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, question_id, session_ids): sorted distinct sessions of the turns that a question cites."""
    ids = questions.select("conv_id", "question_id", F.explode_outer("source_ids").alias("turn_id"))
    hit = ids.join(turns.select("conv_id", "turn_id", "session"), ["conv_id", "turn_id"], "left")
    return hit.groupBy("conv_id", "question_id").agg(F.array_sort(F.collect_set("session")).alias("session_ids"))


def first_filled(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def ingest_groups(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, job, ...): a job ends after each assistant turn; turns after the last are dropped."""
    w = Window.partitionBy(by).orderBy("turn")
    done = F.sum((F.col("role") == "assistant").cast("bigint")).over(w)
    t = turns.withColumn("job", done - (F.col("role") == "assistant").cast("bigint"))
    return t.withColumn("_total", F.sum((F.col("role") == "assistant").cast("bigint")).over(Window.partitionBy(by))).filter("job < _total").drop("_total")


def lookup_answers(questions: DataFrame, answers: DataFrame, prefix: int = 60) -> DataFrame:
    """(question_id, answer_id): equal texts, else the smallest answer whose first letters stand in the question or the reverse.

    The rest that has no equal text is matched in blocks of answers held by each task: answers are bounded by the evaluation set.
    """
    exact = questions.join(answers.select("answer_id", F.col("answer_text").alias("question_text")), "question_text").groupBy("question_id").agg(F.min("answer_id").alias("answer_id"))
    rest = questions.join(exact, "question_id", "left_anti")
    a = answers.select("answer_id", "answer_text", F.substring("answer_text", 1, prefix).alias("_a"))
    near = rest.join(F.broadcast(a), F.contains("question_text", F.col("_a")) | F.contains("answer_text", F.substring("question_text", 1, prefix)))
    return exact.unionByName(near.groupBy("question_id").agg(F.min("answer_id").alias("answer_id")))


def parse_verdict(raw: Column) -> Column:
    """struct<winner, overall, scores> of a judge's answer; winner `error` where it is no JSON object."""
    x = F.from_json(X.strip_fences(raw), "winner string, overall double, scores array<double>")
    return F.struct(F.coalesce(F.lower(x["winner"]), F.lit("error")).alias("winner"), x["overall"].alias("overall"), x["scores"].alias("scores"))


def rubric_score(scores: Column) -> Column:
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.size(scores))


def by_type(judged: DataFrame, systems: tuple[str, str] = ("ours", "theirs")) -> DataFrame:
    """Averages, wins and ties by question type. judged: question_type, winner and a score column for each system."""
    a, b = systems
    return judged.groupBy("question_type").agg(
        F.count("*").alias("n"), F.round(F.avg(a), 6).alias(f"avg_{a}"), F.round(F.avg(b), 6).alias(f"avg_{b}"),
        F.count_if(F.col("winner") == a).alias(f"wins_{a}"), F.count_if(F.col("winner") == b).alias(f"wins_{b}"), F.count_if(F.col("winner") == "tie").alias("ties"),
    )


def overall(judged: DataFrame, systems: tuple[str, str] = ("ours", "theirs")) -> DataFrame:
    a, b = systems
    d = judged.agg(F.count("*").alias("n"), F.round(F.avg(a), 6).alias(f"avg_{a}"), F.round(F.avg(b), 6).alias(f"avg_{b}"), F.round(100.0 * F.count_if(F.col("winner") == a) / F.count("*"), 6).alias(f"win_pct_{a}"), F.round(100.0 * F.count_if(F.col("winner") == "tie") / F.count("*"), 6).alias("tie_pct"))
    return d.withColumn("best", F.when(F.col(f"avg_{a}") > F.col(f"avg_{b}"), a).when(F.col(f"avg_{a}") < F.col(f"avg_{b}"), b).otherwise("tie"))


def answered(questions: DataFrame, answer, columns: str = "question_id bigint, answer string, latency double") -> DataFrame:
    """Answers of an injected model: answer(question_text) -> text, timed, a batch of questions a task."""
    import time

    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for q in b["question_text"]:
                t = time.time()
                out.append((answer(q), time.time() - t))
            yield pd.DataFrame({"question_id": b["question_id"], "answer": [a for a, _ in out], "latency": [s for _, s in out]})

    return questions.select("question_id", "question_text").mapInPandas(run, columns)


def judged(answers: DataFrame, expected: DataFrame, judge) -> DataFrame:
    """(question_id, verdict) of an injected judge: judge(answer, expected_text) -> raw text, parsed; failures become errors."""
    import pandas as pd

    def run(batches):
        for b in batches:
            raw = []
            for a, e in zip(b["answer"], b["expected"], strict=True):
                try:
                    raw.append(judge(a, e))
                except Exception as x:
                    raw.append(f"error: {x}")
            yield pd.DataFrame({"question_id": b["question_id"], "raw": raw})

    both = answers.join(expected, "question_id").select("question_id", "answer", "expected")
    return both.mapInPandas(run, "question_id bigint, raw string").select("question_id", parse_verdict(F.col("raw")).alias("verdict"))
