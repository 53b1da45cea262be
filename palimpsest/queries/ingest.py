"""Queue, extraction, denoising and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import denoise as N
from palimpsest.operators import evaluate as V
from palimpsest.operators import queue as Q

from .shared import table


def format_turns(spark, d):
    p = Q.format_turns(table(spark, d, "conversations"))
    return p.select("conv_id", F.length("raw_prompt").cast("bigint").alias("n_chars"), F.sha2("raw_prompt", 256).alias("prompt_sha256"))


def _pairs(spark, d):
    return Q.pair_turns(table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), "conv_id", "turn")


def turn_pairs(spark, d):
    return _pairs(spark, d).select("conv_id", "pair", F.sha2("text", 256).alias("text_sha256"))


def partition_chunks(spark, d):
    return Q.chunk_pairs(_pairs(spark, d), "conv_id", 600, 150).select("conv_id", "pair", "chunk")


def parse_prompts(spark, d):
    """Prompts of conversations parsed back into turns."""
    t = Q.parse_turns(Q.format_turns(table(spark, d, "conversations").filter("role <> 'system'")), "conv_id")
    return t.select("conv_id", "n", "role", F.sha2("content", 256).alias("content_sha256"))


def _queue(spark, d):
    """Turns as queued jobs of seven users; the day goes on by a day every forty conversations."""
    c = table(spark, d, "conversations")
    return c.select(F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id div 40 as int)) as timestamp_ntz)").alias("ts"), F.col("text").alias("raw_prompt"))


def consolidate_jobs(spark, d):
    return Q.consolidate(_queue(spark, d), 1500, 2500).select("user_id", "id", "jobs", F.sha2("raw_prompt", 256).alias("prompt_sha256"), F.to_date("ts").alias("ts_day"))


def _jobs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, ("pending", "processing", "failed", "done"))), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), (F.col("event_id") % 7).cast("int").alias("retry_count"))


def job_pick(spark, d):
    return Q.pick_jobs(_jobs(spark, d)).select("id", "status", F.col("retry_count").cast("bigint").alias("retry_count"))


def job_status(spark, d):
    jobs = _jobs(spark, d)
    outcome = jobs.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 3 == 1, "done").otherwise("failed").alias("new_status"))
    return Q.mark(jobs, outcome).groupBy("status", "retry_count").agg(F.count("*").alias("n")).withColumn("retry_count", F.col("retry_count").cast("bigint"))


def strip_timestamps(spark, d):
    e = table(spark, d, "events")
    said = F.concat(F.lit("seen "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" by "), F.col("event_type"))
    return e.select("event_id", X.strip_timestamps(said).alias("text"))


def clean_prompt(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.sha2(X.clean_prompt(F.col("text")), 256).alias("clean_sha256"))


def exact_dedup(spark, d):
    doc = table(spark, d, "documents").select(F.lit("default").alias("user_id"), F.col("lang").alias("memory_type"), F.col("text").alias("content"), "doc_id", "source")
    stored = doc.filter("source = 'src3'")
    return Q.dedup_memories(doc.filter("source <> 'src3'"), stored, ("doc_id",)).select("doc_id", "memory_type")


def id_allocation(spark, d):
    from palimpsest.sources.tables import next_ids

    doc = table(spark, d, "documents")
    return next_ids(doc.filter("lang = 'fr'").select("doc_id"), doc.filter("lang <> 'fr'").select(F.col("doc_id").alias("id")), ["doc_id"]).select("doc_id", F.col("id").cast("bigint").alias("id"))


def leaf_embed_text(spark, d):
    doc = table(spark, d, "documents").withColumn("leaf", F.concat_ws(" > ", "lang", "source"))
    kept = Q.budgeted(doc, "leaf", [F.col("doc_id").desc()], F.length("text").cast("bigint") + 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("doc_id")).alias("o"), "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("leaf").agg(F.count("*").alias("items"), F.sha2(F.concat_ws("\n", F.first("leaf"), body), 256).alias("text_sha256"))


def extraction_flatten(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    doc = F.concat(F.lit('{"topics_root":["'), F.col("event_type"), F.lit('"],"memory":[{"topics_branch":["u'), (F.col("user_id") % 5).cast("string"), F.lit('"],"user":["'), F.col("user_id").cast("string"), F.lit('"],"fact":["k'), k.cast("string"), F.lit('","v"],"epis":[],"decision":[]}]}'))
    j = e.select(F.col("event_id").alias("job_id"), F.from_json(doc, "topics_root array<string>, memory array<struct<topics_branch:array<string>,user:array<string>,fact:array<string>,epis:array<string>,decision:array<string>>>").alias("doc"))
    return Q.flatten_extraction(j).select("job_id", "memory_type", "content", F.array_join("chain", " > ").alias("path"), F.col("pos").cast("bigint").alias("pos"))


def summary_batches(spark, d):
    doc = table(spark, d, "documents").select("lang", "doc_id", F.length("text").cast("bigint").alias("n"))
    return Q.greedy_batches(doc, "lang", "doc_id", "n", 8000).select("lang", "doc_id", "batch")


def flatten_turns(spark, d):
    c = table(spark, d, "conversations")
    nested = c.groupBy("conv_id", (F.col("turn") % 2).alias("s")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), "role", F.col("text").alias("content")))).alias("turns"))
    convs = nested.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "turns"))), lambda x: x["turns"]).alias("sessions"))
    return V.flatten_sessions(convs).select("conv_id", F.col("session").cast("bigint").alias("session"), "turn_id", "role", F.length("content").cast("bigint").alias("n_chars"))


def evidence_sessions(spark, d):
    c = table(spark, d, "conversations")
    turns = c.select("conv_id", F.col("turn").alias("turn_id"), (F.col("turn") % 3).alias("session"))
    q = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("source_ids")).withColumn("question_id", F.col("conv_id"))
    return V.evidence_sessions(q, turns).select("conv_id", F.array_join(F.transform("session_ids", lambda x: x.cast("string")), ",").alias("sessions"))


def ingest_jobs(spark, d):
    return V.ingest_groups(table(spark, d, "conversations")).groupBy("conv_id", "job").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


def answers_index(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.sha2(F.lower(F.trim(F.col("text"))), 256).alias("text_key"))
    return b.groupBy("text_key").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


def fuzzy_answer_lookup(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer_text"))
    q = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question_text"))
    return V.lookup_answers(q, b)


def date_parse(spark, d):
    e = table(spark, d, "events")
    forms = F.array(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "MMMM-dd-yyyy"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    return e.select("event_id", Q.to_time(F.element_at(forms, (F.col("event_id") % 4 + 1).cast("int"))).alias("at"))


def line_classify(spark, d):
    t = N.classify_lines(N.lines_of(table(spark, d, "documents")))
    return t.groupBy("doc_id", "line_type").agg(F.count("*").alias("n_lines"))


def block_segments(spark, d):
    b = N.blocks(N.classify_lines(N.lines_of(table(spark, d, "documents"))))
    return b.select("doc_id", "block", "line_type", "n_lines")


def log_fuzzy_dedup(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), "event_type", F.lit(" user "), F.col("user_id").cast("string"))
    entries = e.select((F.col("user_id") % 50).alias("doc_id"), F.col("event_id").alias("entry"), line.alias("text"))
    mask = F.regexp_replace(F.regexp_replace("text", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} ", ""), r"\b[0-9]+\b", "<ID>")
    return N.collapse_log(entries, "doc_id", mask).select("doc_id", "run", "repeated", F.sha2("first_text", 256).alias("first_sha256"))


def code_skeleton(spark, d):
    script = F.regexp_extract("html", r"(?s)<script[^>]*>(.*?)</script>", 1)
    return table(spark, d, "pages").select("page_id", N.skeletons(F.regexp_replace(script, ";", ";\n")).alias("skeleton"))


def json_cleanup(spark, d):
    e = table(spark, d, "events")
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", F.get_json_object(X.strip_fences(fenced), "$.k").cast("bigint").alias("k"), X.collapse_loops(F.concat(F.lit("a\n\n\n\n"), F.col("event_type"), F.lit("\t\t\t\tb"))).alias("said"))


def _judged(spark, d):
    doc = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    ours, theirs = (F.col("doc_id") % 10) / 10.0, (F.col("n_chars") % 10) / 10.0
    j = doc.select("doc_id", F.col("lang").alias("question_type"), ours.alias("ours"), theirs.alias("theirs"), "quality")
    return j.withColumn("winner", F.when(F.col("ours") > F.col("theirs"), "ours").when(F.col("ours") < F.col("theirs"), "theirs").otherwise("tie")).filter("quality = 1")


def eval_by_type(spark, d):
    return V.by_type(_judged(spark, d))


def eval_overall(spark, d):
    return V.overall(_judged(spark, d))


def rubric_scores(spark, d):
    lab = table(spark, d, "labels")
    raw = F.concat(F.lit('```json\n{"winner":"OURS","overall":'), F.col("quality").cast("string"), F.lit(',"scores":['), F.col("quality").cast("string"), F.lit(","), F.col("toxic").cast("string"), F.lit(",1]}\n```"))
    v = V.parse_verdict(F.when(F.col("doc_id") % 5 == 0, F.lit("no json")).otherwise(raw))
    return lab.select("doc_id", v.alias("v")).select("doc_id", "v.winner", F.round(V.rubric_score(F.col("v.scores")), 6).alias("rubric"), (V.rubric_score(F.col("v.scores")) == 1).alias("strict_pass"))


QUERIES = {f.__name__: f for f in (
    format_turns, turn_pairs, partition_chunks, parse_prompts, consolidate_jobs, job_pick, job_status, strip_timestamps, clean_prompt, exact_dedup, id_allocation, leaf_embed_text,
    extraction_flatten, summary_batches, flatten_turns, evidence_sessions, ingest_jobs, answers_index, fuzzy_answer_lookup, date_parse, line_classify, block_segments, log_fuzzy_dedup,
    code_skeleton, json_cleanup, eval_by_type, eval_overall, rubric_scores,
)}

_CAP = "upper(left(role, 1)) || lower(substring(role, 2))"
_PAIRS = f"""h AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER w = 'user' THEN 0 ELSE 1 END AS head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  n AS (SELECT *, sum(head) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS pair FROM h),
  p AS (SELECT conv_id, pair, string_agg({_CAP} || ': ' || text, chr(10) ORDER BY turn) AS text FROM n GROUP BY 1, 2)"""
_QUEUE = "q AS (SELECT 'u' || (conv_id % 7) AS user_id, conv_id * 1000 + turn AS id, DATE '2024-01-01' + (conv_id // 40)::INT AS ts_day, text AS raw_prompt, length(text) AS size FROM conversations)"


def _fold(name: str, src: str, soft: str, hard: int) -> str:
    """Recursive CTE of the greedy fold over src (user_id, id, ts_day, size): name (user_id, id, batch)."""
    return f"""{name}_s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS rn FROM {src}),
  {name}_r AS (SELECT user_id, id, rn, id AS batch, size AS acc, ts_day, size >= {soft} AS closed FROM {name}_s WHERE rn = 1
    UNION ALL SELECT s.user_id, s.id, s.rn, CASE WHEN r.closed OR r.acc + s.size > {hard} OR s.ts_day <> r.ts_day THEN s.id ELSE r.batch END,
      CASE WHEN r.closed OR r.acc + s.size > {hard} OR s.ts_day <> r.ts_day THEN s.size ELSE r.acc + s.size END, s.ts_day,
      (CASE WHEN r.closed OR r.acc + s.size > {hard} OR s.ts_day <> r.ts_day THEN s.size ELSE r.acc + s.size END) >= {soft} FROM {name}_r r JOIN {name}_s s ON s.user_id = r.user_id AND s.rn = r.rn + 1),
  {name} AS (SELECT user_id, id, batch FROM {name}_r)"""


#: The code pattern for an engine whose \\b knows ASCII words only: what must follow is spelled out.
_CODE_SQL = r"""(?i)^\s*((if|else|elif|for|while|do|switch|case|default|break|return|try|except|catch|finally|throw|raise|await|async|def|class|function|interface|struct|enum|print|printf|sys|import|from|#include|var|let|const|public|private|int|float|void|string)($|[^\p{L}\p{Nd}_])|(\}|\{|\]|\[|\)|//|#\s|/\*|["''])[\p{L}\p{Nd}_]|[\w\._]+\s*=\s*[\p{L}\p{Nd}_])"""
_LINES = """l AS (SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> ''),
 k AS (SELECT *, CASE WHEN regexp_matches(trim(line), '""" + N.LOG.replace("'", "''") + """') THEN 'LOG' WHEN regexp_matches(trim(line), '""" + _CODE_SQL + """') THEN 'CODE' WHEN regexp_matches(trim(line), '""" + N.SENTENCE + """') THEN 'TEXT'
   WHEN NOT regexp_matches(line, '^\\s') THEN 'TEXT' END AS own FROM l),
 t AS (SELECT doc_id, pos, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'TEXT') AS line_type FROM k)"""
_JUDGED = """j AS (SELECT d.doc_id, lang AS question_type, (d.doc_id % 10) / 10.0 AS ours, (n_chars % 10) / 10.0 AS theirs FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1),
 w AS (SELECT *, CASE WHEN ours > theirs THEN 'ours' WHEN ours < theirs THEN 'theirs' ELSE 'tie' END AS winner FROM j)"""
_CLEAN = "text"
for _p, _r in X.CLEANUP:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r.replace('$', chr(92)).replace(chr(92) * 2, chr(92)) if _r.startswith(('$', '(')) else _r.replace(chr(92), chr(92) * 2)}', 'g')"
ORACLE_SQL = {
    "format_turns": f"WITH p AS (SELECT conv_id, string_agg({_CAP} || ': ' || trim(text), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, length(t) AS n_chars, sha256(t) AS prompt_sha256 FROM p",
    "turn_pairs": f"WITH {_PAIRS} SELECT conv_id, pair, sha256(text) AS text_sha256 FROM p",
    "partition_chunks": f"""WITH RECURSIVE {_PAIRS}, s AS (SELECT conv_id, pair, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY pair) AS rn FROM p),
      r AS (SELECT conv_id, pair, rn, n, 1::BIGINT AS chunk, CASE WHEN n >= 600 THEN 0 ELSE n END AS acc, n >= 600 AS closed FROM s WHERE rn = 1
        UNION ALL SELECT s.conv_id, s.pair, s.rn, s.n, r.chunk + CASE WHEN r.closed THEN 1 ELSE 0 END, CASE WHEN r.acc + s.n >= 600 THEN 0 ELSE r.acc + s.n END, r.acc + s.n >= 600 FROM r JOIN s ON s.conv_id = r.conv_id AND s.rn = r.rn + 1),
      z AS (SELECT *, max(chunk) OVER (PARTITION BY conv_id) AS last, sum(n) OVER (PARTITION BY conv_id, chunk) AS chars FROM r)
      SELECT conv_id, pair, CASE WHEN chunk = last AND chars < 150 AND last > 1 THEN chunk - 1 ELSE chunk END AS chunk FROM z""",
    "parse_prompts": f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_CAP} AS role, sha256(trim(text)) AS content_sha256 FROM conversations WHERE role <> 'system'",
    "consolidate_jobs": f"""WITH RECURSIVE {_QUEUE}, {_fold("f", "q", "1500", 2500)}, u AS (SELECT q.user_id, f.batch AS id, sum(size)::BIGINT AS size, arg_max(ts_day, q.id) AS ts_day FROM q JOIN f ON q.id = f.id GROUP BY 1, 2),
      {_fold("g", "u", "4611686018427387904", 2500)} SELECT q.user_id, g.batch AS id, count(*) AS jobs, sha256(string_agg(raw_prompt, chr(10) || chr(10) ORDER BY q.id)) AS prompt_sha256, arg_max(ts_day, q.id) AS ts_day
      FROM q JOIN f ON q.id = f.id JOIN g ON f.batch = g.id GROUP BY 1, 2""",
    "job_pick": "SELECT event_id AS id, ['pending','processing','failed','done'][event_id % 4 + 1] AS status, event_id % 7 AS retry_count FROM events WHERE event_id % 4 < 3 AND event_id % 7 < 5 ORDER BY event_id LIMIT 30",
    "job_status": "WITH j AS (SELECT event_id AS id, ['pending','processing','failed','done'][event_id % 4 + 1] AS s, event_id % 7 AS r FROM events WHERE event_id % 3 <> 1) SELECT CASE WHEN id % 3 = 2 THEN 'failed' ELSE s END AS status, CASE WHEN id % 3 = 2 THEN r + 1 ELSE r END AS retry_count, count(*) AS n FROM j GROUP BY 1, 2",
    "strip_timestamps": r"SELECT event_id, trim(regexp_replace('seen ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' by ' || event_type, '\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?\b', '', 'g')) AS text FROM events",
    "clean_prompt": f"SELECT doc_id, sha256(regexp_replace({_CLEAN}, '^\\s+|\\s+$', '', 'g')) AS clean_sha256 FROM documents",
    "exact_dedup": "WITH h AS (SELECT doc_id, lang AS memory_type, source, sha256(lower(trim(text))) AS k FROM documents) SELECT min(doc_id) AS doc_id, memory_type FROM h WHERE source <> 'src3' AND NOT EXISTS (SELECT 1 FROM h s WHERE s.source = 'src3' AND s.memory_type = h.memory_type AND s.k = h.k) GROUP BY memory_type, k",
    "id_allocation": "SELECT doc_id, (SELECT coalesce(max(doc_id), 0) FROM documents WHERE lang <> 'fr') + row_number() OVER (ORDER BY doc_id) AS id FROM documents WHERE lang = 'fr'",
    "leaf_embed_text": "WITH b AS (SELECT *, lang || ' > ' || source AS leaf, coalesce(sum(length(text) + 1) OVER (PARTITION BY lang, source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT leaf, count(*) AS items, sha256(leaf || chr(10) || string_agg(text, chr(10) ORDER BY doc_id DESC)) AS text_sha256 FROM b WHERE before < 8000 GROUP BY leaf",
    "extraction_flatten": """WITH e AS (SELECT event_id AS job_id, event_type || ' > u' || (user_id % 5) AS path, user_id, props->>'$.k' AS k FROM events)
      SELECT job_id, 'user' AS memory_type, user_id::VARCHAR AS content, path, 0::BIGINT AS pos FROM e UNION ALL SELECT job_id, 'knowledge', 'k' || k, path, 0 FROM e WHERE k IS NOT NULL UNION ALL SELECT job_id, 'knowledge', 'v', path, 1 FROM e WHERE k IS NOT NULL""",
    "summary_batches": """WITH RECURSIVE s AS (SELECT lang, doc_id, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
      r AS (SELECT lang, doc_id, rn, 1::BIGINT AS batch, n AS acc FROM s WHERE rn = 1 UNION ALL SELECT s.lang, s.doc_id, s.rn, r.batch + CASE WHEN r.acc + s.n > 8000 THEN 1 ELSE 0 END, CASE WHEN r.acc + s.n > 8000 THEN s.n ELSE r.acc + s.n END FROM r JOIN s ON s.lang = r.lang AND s.rn = r.rn + 1)
      SELECT lang, doc_id, batch FROM r""",
    "flatten_turns": "WITH s AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn % 2) - 1 AS session FROM conversations) SELECT conv_id, session, turn AS turn_id, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY session) AS n FROM s) WHERE n = 1",
    "evidence_sessions": "SELECT conv_id, array_to_string(list_sort(list_distinct(list(turn % 3))), ',') AS sessions FROM conversations GROUP BY 1",
    "ingest_jobs": "WITH r AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS job, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT conv_id, job, count(*) AS turns, min(turn) AS first_turn FROM r WHERE job < total GROUP BY 1, 2",
    "answers_index": "SELECT sha256(lower(trim(text))) AS text_key, min(item_id) AS item_id, count(*) AS n FROM benchmark GROUP BY 1",
    "fuzzy_answer_lookup": "WITH x AS (SELECT d.doc_id, min(b.item_id) AS item_id FROM documents d JOIN benchmark b ON d.text = b.text GROUP BY 1) SELECT doc_id AS question_id, item_id AS answer_id FROM x UNION ALL SELECT d.doc_id, min(b.item_id) FROM documents d JOIN benchmark b ON contains(d.text, substring(b.text, 1, 60)) OR contains(b.text, substring(d.text, 1, 60)) WHERE d.doc_id NOT IN (SELECT doc_id FROM x) GROUP BY 1",
    "date_parse": "SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END AS at FROM events",
    "line_classify": f"WITH {_LINES} SELECT doc_id, line_type, count(*) AS n_lines FROM t GROUP BY 1, 2",
    "block_segments": f"WITH {_LINES}, c AS (SELECT *, CASE WHEN line_type <> lag(line_type) OVER (PARTITION BY doc_id ORDER BY pos) OR lag(line_type) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS ch FROM t), b AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS block FROM c) SELECT doc_id, block, max(line_type) AS line_type, count(*) AS n_lines FROM b GROUP BY 1, 2",
    "log_fuzzy_dedup": r"""WITH e AS (SELECT user_id % 50 AS doc_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || event_type || ' user ' || user_id AS text, 'INFO ' || event_type || ' user <ID>' AS mask FROM events),
      c AS (SELECT *, CASE WHEN mask IS DISTINCT FROM lag(mask) OVER (PARTITION BY doc_id ORDER BY event_id) THEN 1 ELSE 0 END AS ch FROM e), r AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY event_id)::BIGINT AS run FROM c)
      SELECT doc_id, run, count(*) - 1 AS repeated, sha256(arg_min(text, event_id)) AS first_sha256 FROM r GROUP BY 1, 2""",
    "json_cleanup": "SELECT event_id, (props->>'$.k')::BIGINT AS k, 'a ' || event_type || ' b' AS said FROM events",
    "eval_by_type": f"WITH {_JUDGED} SELECT question_type, count(*) AS n, round(avg(ours), 6) AS avg_ours, round(avg(theirs), 6) AS avg_theirs, count_if(winner = 'ours') AS wins_ours, count_if(winner = 'theirs') AS wins_theirs, count_if(winner = 'tie') AS ties FROM w GROUP BY 1",
    "eval_overall": f"WITH {_JUDGED}, a AS (SELECT count(*) AS n, round(avg(ours), 6) AS avg_ours, round(avg(theirs), 6) AS avg_theirs, round(100.0 * count_if(winner = 'ours') / count(*), 6) AS win_pct_ours, round(100.0 * count_if(winner = 'tie') / count(*), 6) AS tie_pct FROM w) SELECT *, CASE WHEN avg_ours > avg_theirs THEN 'ours' WHEN avg_ours < avg_theirs THEN 'theirs' ELSE 'tie' END AS best FROM a",
    "rubric_scores": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'ours' END AS winner, CASE WHEN doc_id % 5 <> 0 THEN round((quality + toxic + 1) / 3.0, 6) END AS rubric, CASE WHEN doc_id % 5 <> 0 THEN quality + toxic = 2 END AS strict_pass FROM labels",
}
