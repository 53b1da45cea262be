"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mark a query as a broad overview.
BROAD_PHRASES = (
    "summarize", "summary", "compare", "how my understanding", "how did my", "evolved", "developed", "across sessions", "all about",
    "give me an overview", "broad", "explain", "best way to", "show me how", "how does", "what are all", "tell me about", "describe",
    "walk me through", "what happened with", "timeline", "reconstruct", "chronolog",
)
#: What counts as a time stamp inside a prompt.
TIMESTAMP = r"(?im)^Timestamp:.*$|\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-\s]\d{1,2}[-,\s]\d{4}\b"
#: Prompt clean-up rewrites in their order, as (pattern, replacement).
CLEANUP = (
    (r"\t", " "),
    (r"\\\\?\\\[", " "), (r"\\\\?\\\]", " "), (r"\\\\?\\\(", ""), (r"\\\\?\\\)", ""),
    (r"\\{3,}", r"\\"),
    (r"\\(?:text|mathrm|mathbf|textbf)\{([^}]*)\}", "$1"), (r"\\boxed\{([^}]*)\}", "$1"), (r"\\frac\{([^}]*)\}\{([^}]*)\}", "($1/$2)"),
    (r"\\(?:quad|qquad|,|;|!)", " "), (r"\\(?:cdot|times)", "*"), (r"\\equiv", "="), (r"\\pmod\{([^}]*)\}", "(mod $1)"),
    (r"\\(gcd|phi|lambda|sigma|tau|mu)", "$1"), (r"\\(?:left|right|bigg?|Big)", ""), (r"\\([a-zA-Z]{2,})", "$1"), (r"\{([^}]{1,30})\}", "($1)"),
    (r"\n{3,}", "\n\n"), (r" {3,}", " "), (r"[-=*_]{4,}", ""), (r"\b\d{20,}\b", "[large_number]"), (r"\^{2,}", "^"),
    (r"```[a-zA-Z]*\n", "\n"), (r"```", ""), (r"\$\$", " "),
)
#: Masks of a log line in their order.
MASKS = (
    (r"\b[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}\b", "<UUID>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\b0x[0-9a-fA-F]+\b", "<MEM>"),
    (r"\b(?=[a-zA-Z]*\d)[a-zA-Z0-9_]+\b", "<ID>"),
    (r"([\"']).*?\1", "<STR>"),
    (r"\[.*?\]", "<META>"),
    (r"\b\d+\b", "<NUM>"),
)


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def lemma(w: Column) -> Column:
    """The suffix-rule lemma of a lower-cased word."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & w.endswith("sses"), cut(2))
        .when((n > 5) & w.endswith("ing"), cut(3))
        .when((n > 4) & w.endswith("ed"), cut(2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), cut(1))
        .otherwise(w)
    )


def normalize_name(name: Column) -> Column:
    """Topic name for comparison: lower, trimmed, without a leading `general `, single spaces, singular."""
    x = F.trim(F.lower(name))
    x = F.trim(F.when(x.startswith("general "), F.substring(x, F.lit(9), F.length(x))).otherwise(x))
    x = F.regexp_replace(x, r"\s+", " ")
    n = F.length(x)
    return F.when(x.endswith("ies"), F.concat(F.substring(x, F.lit(1), n - 3), F.lit("y"))).when(x.endswith("s") & ~x.endswith("ss"), F.substring(x, F.lit(1), n - 1)).otherwise(x)


def strip_timestamps(text: Column) -> Column:
    return strip(F.regexp_replace(text, TIMESTAMP, ""))


def clean_prompt(text: Column) -> Column:
    for pattern, new in CLEANUP:
        text = F.regexp_replace(text, pattern, new.replace("\\", "\\\\"))
    return strip(text)


def is_broad(query: Column) -> Column:
    low = F.lower(query)
    return F.exists(F.array(*map(F.lit, BROAD_PHRASES)), lambda p: F.contains(low, p))


def classify_query(query: Column) -> Column:
    return F.when(is_broad(query), "broad_overview").otherwise("information_extraction")


def truncate_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, n), " ")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def fuzzy_mask(line: Column, header: str) -> Column:
    """A log line without its header, variable parts masked."""
    line = F.regexp_replace(line, header, "")
    for pattern, new in MASKS:
        line = F.regexp_replace(line, pattern, new)
    return F.trim(line)


def better_name(parent: Column, child: Column) -> Column:
    """The name that survives when a single child folds into its parent: the more telling one, else the child's."""
    p, c = F.lower(F.trim(parent)), F.lower(F.trim(child))
    bare = lambda x: F.trim(F.regexp_replace(x, r"^general\s+", ""))
    general = lambda x: x.startswith("general ")
    return (
        F.when(bare(p) == bare(c), F.when(p.startswith("general"), F.trim(child)).otherwise(F.trim(parent)))
        .when(general(c) & ~general(p), F.trim(parent))
        .when(general(p) & ~general(c), F.trim(child))
        .when(F.contains(c, p), F.trim(child))
        .when(F.contains(p, c), F.trim(parent))
        .otherwise(F.trim(child))
    )


def strip_fences(text: Column) -> Column:
    """Answer text without code fences."""
    return strip(F.regexp_replace(text, r"```[a-zA-Z]*\s*", ""))


def collapse_loops(text: Column) -> Column:
    """Runs of line ends and tabs, a sign of a looping model, become one space."""
    for run in (r"\n{3,}", r"\n\t{2,}", r"\t{3,}"):
        text = F.regexp_replace(text, run, " ")
    return text


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda p, v: p + v)


def unit(v: Column) -> Column:
    """The vector at length one; null and zero vectors stay as they are."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
