"""Input denoising: line classes, blocks, log collapse (JVM side) and the code skeleton (a state machine per text)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

#: Line signals. A log header, a log line, a code line, a plain sentence.
HEADER = r"(?i)^\s*(\[?\d{4}-\d{2}-\d{2}|\[?\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2}\s+\d+|\[?(INFO|WARN|ERROR|DEBUG|FATAL|TRACE|EPOCH))"
LOG = r"(?i)^\s*(\d{4}[-/]\d{2}[-/]\d{2}|\[?\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2}\s+\d{1,2}|\[?(INFO|WARN|ERR|DEBUG|FATAL|CRITICAL|TRACE)|Traceback \(|File\s+['\"]|at\s+[\w\.]+\(|Caused by:|Exception:|Error:|Panic:|Goroutine|GET\s+|POST\s+|PUT\s+|DELETE\s+|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
CODE = r"(?i)^\s*(if|else|elif|for|while|do|switch|case|default|break|return|try|except|catch|finally|throw|raise|await|async|def|class|function|interface|struct|enum|print|printf|sys|import|from|#include|var|let|const|public|private|int|float|void|string|\}|\{|\]|\[|\)|//|#\s|/\*|[\"']|[\w\._]+\s*=\s*)\b"
SENTENCE = r"^[A-Z][^\{\}\;\=\(\)]+\s[^\{\}\;\=\(\)]+[\.\?\!:]$"
LOG_TITLE, CODE_TITLE = "--- [LOG SEGMENT] ---", "--- [CODE SEGMENT] ---"


def lines_of(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of lines that are not blank."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.trim("line") != "")


def classify_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds line_type: LOG, CODE or TEXT; an indented line without a signal goes on with the type above, if that is not TEXT."""
    body = F.trim(F.col("line"))
    own = F.when(body.rlike(LOG), "LOG").when(body.rlike(CODE), "CODE").when(body.rlike(SENTENCE), "TEXT")
    indented = F.col("line").rlike(r"^\s")
    # without a signal and not indented is TEXT too, so only indented lines carry the last own type on
    known = F.when(own.isNotNull(), own).when(~indented, "TEXT")
    w = Window.partitionBy(key).orderBy("pos")
    return lines.withColumn("line_type", F.coalesce(known, F.last(known, ignorenulls=True).over(w), F.lit("TEXT")))


def blocks(typed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, line_type, content): runs of lines of one type."""
    w = Window.partitionBy(key).orderBy("pos")
    change = F.coalesce((F.col("line_type") != F.lag("line_type").over(w)).cast("bigint"), F.lit(1))
    d = typed.withColumn("block", F.sum(change.cast("bigint")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return d.groupBy(key, "block").agg(F.max("line_type").alias("line_type"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("content"), F.count("*").alias("n_lines"))


def log_entries(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entry, text): log lines with their continuation lines (indented, without a header)."""
    w = Window.partitionBy(key).orderBy("pos")
    new = ~(F.col("line").rlike(r"^\s") & ~F.col("line").rlike(HEADER))
    d = lines.withColumn("entry", F.sum(new.cast("bigint")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.trim(F.col("line")).alias("line"))))
    return d.groupBy(key, "entry").agg(F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("text"))


def collapse_log(entries: DataFrame, key: str = "doc_id", mask: Column | None = None) -> DataFrame:
    """(key, run, first_text, repeated): consecutive entries with one mask become the first of them and a count."""
    w = Window.partitionBy(key).orderBy("entry")
    d = entries.withColumn("mask", X.fuzzy_mask(F.col("text"), HEADER) if mask is None else mask)
    d = d.withColumn("run", F.sum(F.coalesce((F.col("mask") != F.lag("mask").over(w)).cast("bigint"), F.lit(1)).cast("bigint")).over(w))
    return d.groupBy(key, "run").agg(F.min_by("text", "entry").alias("first_text"), (F.count("*") - 1).alias("repeated"))


#: Words that begin an import, a definition or a type, and control flow; what ends a comment that began with the key.
IMPORTS = frozenset("import from using package library include require".split())
HEADS = frozenset("def class function async public private protected internal static void struct interface enum union template namespace int float double char bool string".split())
CONTROL = frozenset("if for while switch catch else elif try except finally do case default with".split())
COMMENTS = {'"""': '"""', "'''": "'''", "/*": "*/"}


def _open_comment(line: str, waits: str | None) -> str | None:
    """What would end the block comment that is open after the line; waits: the same before it."""
    at = 0
    while True:
        if waits:
            end = line.find(waits, at)
            if end < 0:
                return waits
            at, waits = end + len(waits), None
        begins = [(p, k) for k in COMMENTS if (p := line.find(k, at)) >= 0]
        if not begins:
            return None
        p, k = min(begins)
        at, waits = p + len(k), COMMENTS[k]


def _constant(body: str) -> bool:
    name, eq, _ = body.partition("=")
    name = name.strip()
    return bool(eq) and (body.startswith("const ") or name.isidentifier() and name == name.upper())


def skeleton(code: str | None) -> str:
    """Comments, imports, decorators, constants, signatures and returns of a code text; bodies go.

    Block comments stay whole. A signature may take several lines, up to the one that opens its block; any line that opens a block
    and is no control flow counts as one. Constants count outside of bodies only.
    """
    out, waits, unfinished = [], None, False
    bodies: list[int] = []  # indents of the signatures around
    for line in (code or "").split("\n"):
        was, waits = waits, _open_comment(line, waits)
        body, indent = line.strip(), len(line) - len(line.lstrip())
        word = (re.match(r"[\s#@}]*(\w*)", line) or [""])[1]
        while bodies and body and indent <= bodies[-1] and body[0] not in "{}":
            bodies.pop()
        opens = body.endswith(("{", ":"))
        head = unfinished or word.lower() in HEADS or opens and word not in CONTROL and body not in ("{", "} else {")
        comment = was or waits or any(x in body for x in ("#", "//", "/*", *COMMENTS))
        if comment or word in IMPORTS or body.startswith("@") or head or word == "return" or not bodies and _constant(body):
            out.append(line.rstrip())
        if head and not comment:
            unfinished = not opens and (unfinished or "(" in body) and not body.endswith((";", "}"))
            if opens:
                bodies.append(indent)
    return "\n".join(out)


def _skeleton_series(code: pd.Series) -> pd.Series:
    return code.map(skeleton)


def skeletons(code: Column) -> Column:
    """The skeleton of each text; Arrow batches, as the state machine has no SQL form."""
    return F.pandas_udf(_skeleton_series, "string")(code)


def compressed(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, compressed): a text of one TEXT block as it is, else titled segments; the text itself where nothing is left."""
    bl = blocks(classify_lines(lines_of(texts, key, text), key), key)
    logs = lines_of(bl.filter("line_type = 'LOG'").select(F.struct(key, "block").alias("_k"), "content"), "_k", "content")
    said = collapse_log(log_entries(logs, "_k"), "_k")
    line = F.when(F.col("repeated") > 0, F.concat("first_text", F.lit(" (repeated "), F.col("repeated").cast("string"), F.lit(" times)"))).otherwise(F.col("first_text"))
    said = said.groupBy("_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    bl = bl.join(said.select(F.col(f"_k.{key}").alias(key), F.col("_k.block").alias("block"), "log"), [key, "block"], "left")
    body = F.when(F.col("line_type") == "LOG", F.concat(F.lit(LOG_TITLE + "\n"), "log")).when(F.col("line_type") == "CODE", F.concat(F.lit(CODE_TITLE + "\n"), skeletons(F.col("content")))).otherwise(F.trim(F.col("content")))
    bl = bl.withColumn("body", body)
    out = bl.groupBy(key).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda x: x["body"]), "\n")).alias("out"), F.count("*").alias("n"), F.max("line_type").alias("t"), F.min("line_type").alias("u"))
    own = texts.select(key, F.col(text).alias("_text")).join(out, key, "left")
    plain = (F.col("n") == 1) & (F.col("t") == "TEXT") & (F.col("u") == "TEXT")
    return own.select(key, F.when(plain | F.col("out").isNull() | (F.col("out") == ""), F.trim("_text")).otherwise(F.col("out")).alias("compressed"))
