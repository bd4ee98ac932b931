"""Keys, markers, token estimates, line importance, adaptive sizes: Columns without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_word, sql_has_word

#: Fixed values.
ERROR = ["error", "exception", "fail", "failed", "failure", "fatal", "critical", "crash", "panic", "abort", "timeout", "denied", "rejected"]
IMPORTANCE = ["important", "note", "todo", "fixme", "hack", "xxx", "bug", "fix"]
WARNING = ["warn", "warning"]
SECURITY = ["security", "auth", "password", "secret"]
MARKDOWN = ["# ", "## ", "### ", "#### ", "**", "> "]
INDICATORS = ["error", "fail", "exception", "traceback", "fatal", "panic", "crash"]
PRIORITY = {"error": 0.95, "security": 0.85, "warning": 0.75, "importance": 0.6, "markdown": 0.45}
MATCH_CONFIDENCE = 0.7
HOT_TYPES = ["tool_use", "thinking", "redacted_thinking", "compaction"]


def key_md5(content: Column) -> Column:
    return F.substring(F.md5(content.cast("binary")), 1, 24)


def key_strong(content: Column) -> Column:
    """24 hex digits of SHA-256, where BLAKE3 isn't at hand."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 24)


def marker(key: Column) -> Column:
    return F.concat(F.lit("<<ccr:"), key, F.lit(">>"))


def cell_marker(key: Column, kind: Column, size: Column) -> Column:
    """The marker of one opaque cell."""
    return F.concat(F.lit("<<ccr:"), key, F.lit(","), kind, F.lit(","), size.cast("string"), F.lit(">>"))


def lossy_marker(key: Column, rows: Column) -> Column:
    """The marker of rows left out."""
    return F.concat(F.lit("<<ccr:"), key, F.lit(" "), rows.cast("string"), F.lit("_rows_offloaded>>"))


def marker_key(text: Column) -> Column:
    """The key of a canonical marker, else null."""
    key = F.regexp_extract(text, r"\A<<ccr:([0-9a-f]{24})>>\z", 1)
    return F.when(key != "", key)


def token_estimate(text: Column, per_token: float = 4.0) -> Column:
    """Characters over per_token (4 if that isn't positive), rounded half up, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / (per_token if per_token > 0 else 4.0) + 0.5)).cast("long")


def model_tokenizer(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.rlike("^(gpt-4o|o1|o3)"), "o200k_base").when(m.rlike(r"^(gpt-4|gpt-3\.5)"), "cl100k_base").otherwise("estimator")


def importance(line: Column, context: str) -> Column:
    """Category of the highest priority allowed in context (text, search, diff or log), else null."""
    out = F.when(has_word(line, ERROR, True), "error")
    if context == "diff":
        out = out.when(has_word(line, SECURITY, True), "security")
    else:
        out = out.when(has_word(line, WARNING, True), "warning")
    out = out.when(has_word(line, IMPORTANCE, True), "importance")
    if context == "text":
        out = out.when(line.rlike(r"\A(?:#{1,4} |\*\*|> )"), "markdown")
    return out


def importance_sql(line: str, context: str) -> str:
    second = ("security", SECURITY) if context == "diff" else ("warning", WARNING)
    parts = [("error", ERROR), second, ("importance", IMPORTANCE)]
    out = "CASE " + " ".join(f"WHEN {sql_has_word(line, words, True)} THEN '{name}'" for name, words in parts)
    if context == "text":
        out += f" WHEN regexp_matches({line}, '^(#{{1,4}} |\\*\\*|> )') THEN 'markdown'"
    return out + " END"


def priority(category: Column) -> Column:
    out = F.lit(0.0)
    for name, value in PRIORITY.items():
        out = F.when(category == name, value).otherwise(out)
    return out.cast("float")


def signal(line: Column, context: str) -> Column:
    """struct(category, priority, confidence); nulls and zeros where nothing matches."""
    c = importance(line, context)
    return F.struct(c.alias("category"), priority(c).alias("priority"), F.when(c.isNotNull(), MATCH_CONFIDENCE).otherwise(0.0).cast("float").alias("confidence"))


#: A detector of line importance: (line, context) -> struct(category, priority, confidence).  `signal` is the default.
Detector = Callable[[Column, str], Column]


def tiers(*detectors: Detector) -> Detector:
    """One detector of several, by `tiered`."""
    return lambda line, context: tiered(*(d(line, context) for d in detectors))


def tiered(*signals: Column) -> Column:
    """The first signal that is confident enough, else the most confident, else none."""
    enough = F.coalesce(*(F.when(s["confidence"] >= F.lit(0.7).cast("float"), s) for s in signals))
    best = signals[0]
    for s in signals[1:]:
        best = F.when(s["confidence"] > best["confidence"], s).otherwise(best)
    return F.coalesce(enough, best)


def error_indicator(line: Column) -> Column:
    return F.lower(line).rlike("|".join(INDICATORS))


def adaptive_k(n: Column, unique: Column, low: int, high: int, bias: float = 0.0) -> Column:
    """How many of n items to keep, by the share of distinct ones."""
    top = F.lit(high) if high > 0 else n
    knee = F.greatest(F.lit(low), F.floor(n * (F.lit(0.3) + F.lit(0.7) * (unique / n))))
    if bias > 0:
        knee = F.greatest(F.lit(low), F.floor(knee * bias))
    return (F.when(n <= 8, n).when(unique <= 3, F.least(F.greatest(F.lit(low), unique), top))
            .otherwise(F.greatest(F.lit(low), F.least(knee, top)))).cast("long")


def adaptive_k_sql(n: str, u: str, low: int, high: int) -> str:
    return f"(CASE WHEN {n} <= 8 THEN {n} WHEN {u} <= 3 THEN least(greatest({low}, {u}), {high}) ELSE greatest({low}, least(greatest({low}, floor({n} * (0.3::DOUBLE + 0.7::DOUBLE * ({u}::DOUBLE / {n})))), {high})) END)::BIGINT"


def html_tag(name: Column) -> Column:
    """Whether name is a standard HTML element, in any case."""
    from ..operators.tags import HTML_TAGS

    return F.lower(name).isin(HTML_TAGS.split())


def hot_block(kind: Column) -> Column:
    return kind.isin(HOT_TYPES)


def inner_field(kind: Column) -> Column:
    return F.when(kind == "tool_result", "content").when(kind == "text", "text")


def separators(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\},\{")) + F.regexp_count(text, F.lit(r"\}, \{")) + F.regexp_count(text, F.lit("\\},\n"))


def json_bloat(text: Column) -> Column:
    from .text import trim

    n = separators(text)
    ok = trim(text).startswith("[") & (n >= 4)
    return F.when(ok, F.least(F.lit(1.0), n / 49.0)).otherwise(0.0).cast("float")
