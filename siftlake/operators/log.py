"""Condensing logs: ordered lines, ranks and frames, one exchange on the block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LogConfig
from ..functions.scalars import Detector, adaptive_k, adaptive_k_sql, key_md5, signal
from ..functions.text import has_word, split_lines, sql_has_word, trim

#: Words of each level, in order of precedence.
LEVELS = {
    "error": ["ERROR", "error", "Error", "FATAL", "fatal", "Fatal", "CRITICAL", "critical"],
    "fail": ["FAIL", "FAILED", "fail", "failed", "Fail", "Failed"],
    "warn": ["WARN", "WARNING", "warn", "warning", "Warn", "Warning"],
    "info": ["INFO", "info", "Info"],
    "debug": ["DEBUG", "debug", "Debug"],
    "trace": ["TRACE", "trace", "Trace"],
}
SCORES = {"error": 1.0, "fail": 1.0, "warn": 0.5, "debug": 0.05, "trace": 0.02}


def level(line: Column) -> Column:
    out = F
    for name, words in LEVELS.items():
        out = out.when(has_word(line, words), name)
    return out.otherwise("unknown")


def is_stack(line: Column) -> Column:
    """A stack frame of one of five languages."""
    t = trim(line)
    return (t.contains("Traceback (most recent call last)") | (line.contains('File "') & line.contains('", line '))
            | (t.startswith("at ") & t.contains("(") & t.contains(")") & t.rlike(r":\d+:\d+")) | t.rlike(r"\Aat [A-Za-z0-9._$]+\(")
            | (t.startswith("--> ") & t.rlike(r":\d+:\d+")) | t.rlike(r"\A\d+:0x[0-9a-fA-F]+"))


def is_summary(line: Column) -> Column:
    t = trim(line)
    return t.rlike(r"\A(?:===|---|\d+ (?:passed|failed|skipped|error|warning)|(?:Test|Tests|Suite|Suites):?[\t\n\f\r ]*\d|TOTAL|Total|Summary)") | (
        t.rlike(r"\A(?:Build|Compile|Test)") & t.rlike("succeeded|failed|complete"))


def line_score(kind: Column, stack: Column, summary: Column) -> Column:
    base = F.lit(0.1)
    for name, value in SCORES.items():
        base = F.when(kind == name, value).otherwise(base)
    return F.least(F.lit(1.0), F.round(base + F.when(stack, 0.3).otherwise(0.0) + F.when(summary, 0.4).otherwise(0.0), 2))


def warning_key(line: Column) -> Column:
    """What stands up to the first : or =, then the rest with numbers and paths made alike."""
    cut = r"(?s)\A([^:=]*[:=])(.*)\z"
    head = F.regexp_extract(line, cut, 1)
    rest = F.when(head == "", line).otherwise(F.regexp_extract(line, cut, 2))
    rest = F.regexp_replace(F.regexp_replace(rest, r"\d+", "N"), r"0x[0-9a-fA-F]+", "ADDR")
    return F.concat(head, F.regexp_replace(rest, r"/[A-Za-z0-9_/]+/", "/PATH/"))


def log_lines(blocks: DataFrame) -> DataFrame:
    """(block_id, line_no, line, level, is_stack, is_summary, score), lines numbered from 0."""
    x = blocks.select("block_id", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))
    x = x.select("*", level(F.col("line")).alias("level"), is_stack(F.col("line")).alias("is_stack"), is_summary(F.col("line")).alias("is_summary"))
    return x.withColumn("score", line_score(F.col("level"), F.col("is_stack"), F.col("is_summary")))


def log_selected(blocks: DataFrame, config: LogConfig = LogConfig()) -> DataFrame:
    """log_lines with `keep`: windows on the block alone, so one exchange serves them all."""
    c = config
    block = Window.partitionBy("block_id")
    ordered = block.orderBy("line_no")
    of_level = Window.partitionBy("block_id", "level")
    x = log_lines(blocks).withColumn("n", F.count("*").over(block)).withColumn(
        "unique", F.size(F.collect_set("line").over(block)))
    x = x.withColumn("top", F.sum(F.when(F.col("level").isin("error", "fail"), 1)).over(of_level.orderBy("line_no")))
    x = x.withColumn("of_level", F.count("*").over(of_level))
    picked = F.col("level").isin("error", "fail") & ((F.col("top") <= c.max_errors - 1) | (F.col("top") == F.col("of_level")))
    x = x.withColumn("picked", picked).withColumn("near", F.max("picked").over(ordered.rowsBetween(-c.context, c.context)))
    x = x.withColumn("wkey", F.when(F.col("level") == "warn", warning_key(F.col("line"))))
    x = x.withColumn("fresh", (F.col("level") == "warn") & (F.row_number().over(Window.partitionBy("block_id", "wkey").orderBy("line_no")) == 1))
    x = x.withColumn("nth_warning", F.sum(F.col("fresh").cast("int")).over(ordered))
    x = x.withColumn("begins", F.col("is_stack") & ~F.coalesce(F.lag("is_stack").over(ordered), F.lit(False)))
    x = x.withColumn("stack_no", F.sum(F.col("begins").cast("int")).over(ordered))
    x = x.withColumn("in_stack", F.row_number().over(Window.partitionBy("block_id", "stack_no", "is_stack").orderBy("line_no")))
    chosen = (F.col("near") | (F.col("fresh") & (F.col("nth_warning") <= c.max_warnings)) | F.col("is_summary")
              | (F.col("is_stack") & (F.col("stack_no") <= c.max_stacks) & (F.col("in_stack") <= c.stack_lines)))
    x = x.withColumn("chosen", chosen)
    x = x.withColumn("place", F.row_number().over(block.orderBy(F.col("chosen").desc(), F.col("score").desc(), "line_no")))
    cap = F.least(adaptive_k(F.col("n"), F.col("unique"), c.min_keep, c.max_total), F.lit(c.max_total))
    return x.withColumn("keep", F.col("chosen") & (F.col("place") <= cap)).select("block_id", "line_no", "line", "level", "is_stack", "is_summary", "score", "n", "keep")


def log_compress(blocks: DataFrame, config: LogConfig = LogConfig()) -> DataFrame:
    """(block_id, compressed, n_lines, kept, cache_key): kept lines, what was left out, and a marker if the
    gate fires.  A block without lines stays as it is."""
    x = log_selected(blocks, config)
    kept = F.sort_array(F.collect_list(F.when(F.col("keep"), F.struct("line_no", "line"))))

    def left(*levels: str) -> Column:
        return F.sum(F.when(~F.col("keep") & F.col("level").isin(*levels), 1).otherwise(0))

    agg = x.groupBy("block_id").agg(F.max("n").alias("n_lines"), F.array_join(F.transform(kept, lambda p: p["line"]), "\n").alias("body"),
                                    F.sum(F.col("keep").cast("long")).alias("kept"), left("error").alias("e"), left("fail").alias("f"),
                                    left("warn").alias("w"), left("info", "unknown").alias("i"))
    parts = F.concat_ws(", ", *(F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {name}"))) for k, name in (("e", "ERROR"), ("f", "FAIL"), ("w", "WARN"), ("i", "INFO"))))
    footer = F.when(F.col("n_lines") > F.col("kept"), F.concat(F.lit("["), (F.col("n_lines") - F.col("kept")).cast("string"), F.lit(" lines omitted: "), parts, F.lit("]")))
    out = F.concat_ws("\n", F.when(F.col("kept") > 0, F.col("body")), footer)
    full = blocks.select("block_id", "content").join(agg, "block_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).withColumn("kept", F.coalesce("kept", F.lit(0)))
    fires = (F.col("n_lines") >= config.store_min_lines) & ((F.col("kept") / F.col("n_lines")).cast("float") < F.lit(config.store_ratio).cast("float"))
    key = F.when(fires, key_md5(F.col("content")))
    text = F.when(F.col("n_lines") == 0, F.col("content")).otherwise(
        F.concat(out, F.coalesce(F.concat(F.lit("\n["), F.col("n_lines").cast("string"), F.lit(" lines compressed to "), F.col("kept").cast("string"), F.lit(". Retrieve more: hash="), key, F.lit("]")), F.lit(""))))
    return full.select("block_id", text.alias("compressed"), F.col("n_lines").cast("long"), F.col("kept").cast("long"), key.alias("cache_key"))


def log_bloat(content: Column, config: LogConfig = LogConfig(), detector: Detector = signal) -> Column:
    """How repetitive and unimportant (by the detector) the first lines are, 0 to 1; short blocks 0."""
    lines = split_lines(content)
    some = F.slice(lines, 1, config.bloat_sample)
    n = F.size(some)
    low = F.size(F.filter(some, lambda x: detector(x, "log")["priority"] <= F.lit(0.4).cast("float")))
    score = 0.5 * (1 - F.size(F.array_distinct(some)) / n) + 0.5 * (low / n)
    return F.when(F.size(lines) >= config.store_min_lines, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0).cast("float")


def _case(line: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_has_word(line, w)} THEN '{k}'" for k, w in LEVELS.items()) + " ELSE 'unknown' END"


LINES_SQL = """raw_lines AS (SELECT block_id, content, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS line_no, len(p) AS m FROM (SELECT block_id, content, string_split(content, chr(10)) AS p FROM {blocks})),
lines AS (SELECT block_id, line_no, CASE WHEN line_no < m - 1 AND x[-1:] = chr(13) THEN x[:-2] ELSE x END AS line FROM raw_lines WHERE NOT (line_no = m - 1 AND x = ''))"""

CLASS_SQL = rf"""classed AS (SELECT *, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t, {_case('line')} AS level FROM lines),
flagged AS (SELECT block_id, line_no, line, level,
 (contains(t, 'Traceback (most recent call last)') OR (contains(line, 'File "') AND contains(line, '", line ')) OR (starts_with(t, 'at ') AND contains(t, '(') AND contains(t, ')') AND regexp_matches(t, ':\d+:\d+'))
  OR regexp_matches(t, '^at [A-Za-z0-9._$]+\(') OR (starts_with(t, '--> ') AND regexp_matches(t, ':\d+:\d+')) OR regexp_matches(t, '^\d+:0x[0-9a-fA-F]+')) AS is_stack,
 (regexp_matches(t, '^(===|---|\d+ (passed|failed|skipped|error|warning)|(Test|Tests|Suite|Suites):?\s*\d|TOTAL|Total|Summary)') OR (regexp_matches(t, '^(Build|Compile|Test)') AND regexp_matches(t, 'succeeded|failed|complete'))) AS is_summary FROM classed),
scored AS (SELECT *, least(1.0::DOUBLE, round(CASE level WHEN 'error' THEN 1.0 WHEN 'fail' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'debug' THEN 0.05 WHEN 'trace' THEN 0.02 ELSE 0.1 END::DOUBLE + CASE WHEN is_stack THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN is_summary THEN 0.4::DOUBLE ELSE 0 END, 2)) AS score FROM flagged)"""

KEY_SQL = r"""CASE WHEN regexp_matches(line, '[:=]') THEN regexp_extract(line, '^([^:=]*[:=])', 1) ELSE '' END || regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(line, '[:=]') THEN regexp_replace(line, '^[^:=]*[:=]', '') ELSE line END, '\d+', 'N', 'g'), '0x[0-9a-fA-F]+', 'ADDR', 'g'), '/[\w/]+/', '/PATH/', 'g')"""

SELECT_SQL = rf"""u AS (SELECT block_id, count(*) AS n, count(DISTINCT line) AS uq FROM lines GROUP BY block_id),
r1 AS (SELECT s.*, u.n, u.uq, row_number() OVER (PARTITION BY s.block_id, level ORDER BY line_no) AS top, count(*) OVER (PARTITION BY s.block_id, level) AS of_level, {KEY_SQL} AS wkey FROM scored s JOIN u USING (block_id)),
r2 AS (SELECT *, level IN ('error', 'fail') AND (top <= 9 OR top = of_level) AS picked, level = 'warn' AND row_number() OVER (PARTITION BY block_id, level, wkey ORDER BY line_no) = 1 AS fresh, is_stack AND NOT coalesce(lag(is_stack) OVER (PARTITION BY block_id ORDER BY line_no), false) AS begins FROM r1),
r3 AS (SELECT *, max(picked::INT) OVER (PARTITION BY block_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near, sum(fresh::INT) OVER (PARTITION BY block_id ORDER BY line_no) AS nw, sum(begins::INT) OVER (PARTITION BY block_id ORDER BY line_no) AS stack_no FROM r2),
r4 AS (SELECT *, near OR (fresh AND nw <= 5) OR is_summary OR (is_stack AND stack_no <= 3 AND row_number() OVER (PARTITION BY block_id, stack_no, is_stack ORDER BY line_no) <= 20) AS chosen FROM r3),
selected AS (SELECT block_id, line_no, line, level, is_stack, is_summary, score, n, chosen AND row_number() OVER (PARTITION BY block_id ORDER BY chosen DESC, score DESC, line_no) <= {adaptive_k_sql('n', 'uq', 5, 100)} AS keep FROM r4)"""

COMPRESS_SQL = """agg AS (SELECT block_id, max(n) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) FILTER (keep) AS body, count(*) FILTER (keep) AS kept,
 count(*) FILTER (NOT keep AND level = 'error') AS e, count(*) FILTER (NOT keep AND level = 'fail') AS f, count(*) FILTER (NOT keep AND level = 'warn') AS w, count(*) FILTER (NOT keep AND level IN ('info', 'unknown')) AS i FROM selected GROUP BY block_id),
o AS (SELECT b.block_id, content, n_lines, kept, concat_ws(chr(10), body, CASE WHEN n_lines > kept THEN concat('[', n_lines - kept, ' lines omitted: ', concat_ws(', ', CASE WHEN e > 0 THEN e || ' ERROR' END, CASE WHEN f > 0 THEN f || ' FAIL' END, CASE WHEN w > 0 THEN w || ' WARN' END, CASE WHEN i > 0 THEN i || ' INFO' END), ']') END) AS text,
 CASE WHEN n_lines >= 50 AND (kept::DOUBLE / n_lines)::FLOAT < 0.5::FLOAT THEN md5(content)[1:24] END AS cache_key FROM {blocks} b JOIN agg USING (block_id))
SELECT block_id, text || CASE WHEN cache_key IS NULL THEN '' ELSE concat(chr(10), '[', n_lines, ' lines compressed to ', kept, '. Retrieve more: hash=', cache_key, ']') END AS compressed, n_lines::BIGINT AS n_lines, kept::BIGINT AS kept, cache_key FROM o"""
