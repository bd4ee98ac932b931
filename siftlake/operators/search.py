"""Condensing grep-style results: parse, rank files, fill a budget by a clamped running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.scalars import Detector, adaptive_k, adaptive_k_sql, importance_sql, key_md5, signal
from ..functions.text import ascii_lower, fields, split_plain, trim

_LINE = r"(?s)\A(.*?[^:\-])[:\-](\d+)[:\-](.*)\z"


def search_matches(blocks: DataFrame, query: str = "", config: SearchConfig = SearchConfig(), detector: Detector = signal) -> DataFrame:
    """(block_id, seq, file, line_no decimal(20,0), content, score): path, number and text of every result
    line; numbers past 64 bits don't parse.  Query words, the detector's category (if errors are boosted) and
    the config's keywords raise the score."""
    x = blocks.select("block_id", F.posexplode(split_plain(F.col("content"))).alias("seq", "raw")).withColumn("raw", trim(F.col("raw")))
    x = x.where(~F.col("raw").rlike(r"\A[:\-]\d+[:\-]")).withColumn("file", F.regexp_extract("raw", _LINE, 1)).where("file <> ''")
    x = x.withColumn("line_no", F.expr("try_cast(regexp_extract(raw, r'(?s)\\A(.*?[^:\\-])[:\\-](\\d+)[:\\-](.*)\\z', 2) as decimal(20,0))")).where(
        "line_no is not null and line_no <= 18446744073709551615").withColumn("content", F.regexp_extract("raw", _LINE, 3))
    lower = ascii_lower(F.col("content"))
    words = F.filter(fields(ascii_lower(F.lit(query))), lambda w: F.octet_length(w) > 2)
    x = x.withColumn("kind", detector(F.col("content"), "search")["category"]) if config.boost_errors else x
    kind = F.col("kind") if config.boost_errors else F.lit(None).cast("string")
    score = F.size(F.filter(words, lambda w: F.contains(lower, w))) * F.lit(0.3)
    score = score + F.when(kind == "error", 0.5).when(kind == "warning", 0.4).when(kind == "importance", 0.3).otherwise(0.0)
    for k in config.keywords:
        score = score + F.when(F.contains(lower, ascii_lower(F.lit(k))), 0.4).otherwise(0.0)
    return x.select("block_id", "seq", "file", "line_no", "content", F.least(F.lit(1.0), F.round(score, 2)).alias("score"))


def search_selected(blocks: DataFrame, query: str = "", config: SearchConfig = SearchConfig(), detector: Detector = signal) -> DataFrame:
    """Kept matches with their order in the output, each file's number of matches, and each block's matches
    and files."""
    c = config
    m = search_matches(blocks, query, c, detector)
    file = Window.partitionBy("block_id", "file")
    m = m.withColumn("of_file", F.count("*").over(file)).withColumn("nth", F.row_number().over(file.orderBy("seq")))
    m = m.withColumn("pref", F.when(F.col("nth") == 1, 0).when(F.col("nth") == F.col("of_file"), 1).otherwise(2))
    ranked = Window.partitionBy("block_id", "file").orderBy("pref", F.col("score").desc(), "line_no", "seq")
    files = m.groupBy("block_id", "file").agg(F.round(F.sum("score"), 6).alias("total"), F.count_distinct("line_no", "content").alias("unique"), F.count("*").alias("n"))
    whole = Window.partitionBy("block_id")
    files = files.withColumn("n_matches", F.sum("n").over(whole)).withColumn("n_files", F.count("*").over(whole))
    files = files.withColumn("rank", F.row_number().over(whole.orderBy(F.col("total").desc(), "file"))).where(F.col("rank") <= c.files)
    files = files.withColumn("budget", adaptive_k(F.sum("n").over(whole), F.sum("unique").over(whole), c.min_keep, c.total))
    cap = F.least(F.lit(c.per_file), F.col("unique"))
    before = F.coalesce(F.sum(cap).over(whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("take", F.greatest(F.lit(0), F.least(cap, F.col("budget") - before))).where("take > 0").select("block_id", "file", "take", "n_matches", "n_files")
    same = Window.partitionBy("block_id", "file", "line_no", "content").orderBy("pref", "seq")
    best = m.withColumn("copy", F.row_number().over(same)).where("copy = 1").withColumn("place", F.row_number().over(ranked))
    return best.join(files, ["block_id", "file"]).where("place <= take").select("block_id", "file", "line_no", "content", "score", "place", "of_file", "seq", "n_matches", "n_files")


def search_compress(blocks: DataFrame, query: str = "", config: SearchConfig = SearchConfig(), detector: Detector = signal) -> DataFrame:
    """(block_id, compressed, n_matches, kept, files, cache_key); a block without matches stays as it is.
    Blocks are dealt once by block_id; all windows, joins and aggregates go by that or finer."""
    blocks = blocks.select("block_id", "content").repartition("block_id")
    kept = search_selected(blocks, query, config, detector)
    line = F.concat_ws(":", "file", F.col("line_no").cast("string"), "content")
    per = kept.groupBy("block_id", "file").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "place", line.alias("x")))), lambda p: p["x"]), "\n").alias("text"),
        F.count("*").alias("k"), F.max("of_file").alias("n"), F.max("n_matches").alias("n_matches"), F.max("n_files").alias("n_files"))
    more = F.when(F.col("n") > F.col("k"), F.concat(F.lit("[... and "), (F.col("n") - F.col("k")).cast("string"), F.lit(" more matches in "), F.col("file"), F.lit("]")))
    body = per.groupBy("block_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", F.concat_ws("\n", "text", more).alias("x")))), lambda p: p["x"]), "\n").alias("body"),
                                       F.sum("k").alias("kept"), F.max("n_matches").alias("n_matches"), F.max("n_files").alias("files"))
    x = blocks.join(body, "block_id", "left")
    none = F.col("n_matches").isNull()
    fires = (F.col("n_matches") >= config.store_min_matches) & (F.octet_length("body") / F.greatest(F.lit(1), F.octet_length("content")) < config.store_ratio)
    key = F.when(fires, key_md5(F.col("content")))
    mark = F.concat(F.lit("\n["), F.col("n_matches").cast("string"), F.lit(" matches compressed to "), F.col("kept").cast("string"), F.lit(". Retrieve more: hash="), key, F.lit("]"))
    return x.select("block_id", F.when(none, F.col("content")).otherwise(F.concat("body", F.coalesce(mark, F.lit("")))).alias("compressed"),
                    F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
                    F.coalesce("files", F.lit(0)).cast("long").alias("files"), key.alias("cache_key"))


def search_bloat(content: Column) -> Column:
    """How clustered the results are: (lines per prefix up to a number - 1) / 10; under ten lines 0."""
    names = F.filter(F.transform(split_plain(content), lambda x: F.regexp_extract(trim(x), r"(?s)\A(.*?\d)[:\-]", 1)), lambda x: x != "")
    n, u = F.size(names), F.size(F.array_distinct(names))
    return F.when(n >= 10, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n / F.greatest(u, F.lit(1)) - 1) / 10))).otherwise(0.0).cast("float")


def matches_sql(words: list[str], keywords: tuple[str, ...] = ()) -> str:
    worth = [*((w, 0.3) for w in words), *((w.lower(), 0.4) for w in keywords)]
    hits = " + ".join(f"CASE WHEN contains(lower_, '{w}') THEN {v}::DOUBLE ELSE 0 END" for w, v in worth) or "0"
    return rf"""raw AS (SELECT block_id, unnest(p) AS r0, generate_subscripts(p, 1) - 1 AS seq FROM (SELECT block_id, string_split(content, chr(10)) AS p FROM search_blocks)),
raw1 AS (SELECT block_id, seq, trim(r0) AS r FROM raw),
par AS (SELECT block_id, seq, regexp_extract(r, '(?s)^(.*?[^:\-])[:\-](\d+)[:\-](.*)$', 1) AS file, regexp_extract(r, '(?s)^(.*?[^:\-])[:\-](\d+)[:\-](.*)$', 2) AS no, regexp_extract(r, '(?s)^(.*?[^:\-])[:\-](\d+)[:\-](.*)$', 3) AS content FROM raw1 WHERE NOT regexp_matches(r, '^[:\-]\d+[:\-]')),
par1 AS (SELECT block_id, seq, file, try_cast(no AS UBIGINT)::DECIMAL(20,0) AS line_no, content, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_, {importance_sql('content', 'search')} AS kind FROM par WHERE file <> '' AND try_cast(no AS UBIGINT) IS NOT NULL),
m AS (SELECT block_id, seq, file, line_no, content, least(1.0::DOUBLE, round({hits} + CASE kind WHEN 'error' THEN 0.5 WHEN 'warning' THEN 0.4 WHEN 'importance' THEN 0.3 ELSE 0 END::DOUBLE, 2)) AS score FROM par1)"""


SELECT_SQL = f"""m1 AS (SELECT *, count(*) OVER (PARTITION BY block_id, file) AS of_file, row_number() OVER (PARTITION BY block_id, file ORDER BY seq) AS nth FROM m),
m2 AS (SELECT *, CASE WHEN nth = 1 THEN 0 WHEN nth = of_file THEN 1 ELSE 2 END AS pref FROM m1),
f0 AS (SELECT block_id, file, round(sum(score), 6) AS total, count(DISTINCT (line_no, content)) AS uq, count(*) AS n FROM m2 GROUP BY ALL),
f1 AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY total DESC, file) AS rank FROM f0 QUALIFY rank <= 15),
f2 AS (SELECT *, sum(n) OVER (PARTITION BY block_id) AS sn, sum(uq) OVER (PARTITION BY block_id) AS su, coalesce(sum(least(5, uq)) OVER (PARTITION BY block_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM f1),
f3 AS (SELECT block_id, file, greatest(0, least(least(5, uq), {adaptive_k_sql('sn', 'su', 5, 30)} - bef)) AS take FROM f2),
d AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY block_id, file, line_no, content ORDER BY pref, seq) = 1),
k0 AS (SELECT *, row_number() OVER (PARTITION BY block_id, file ORDER BY pref, score DESC, line_no, seq) AS place FROM d),
kept AS (SELECT k0.* FROM k0 JOIN f3 USING (block_id, file) WHERE place <= take)"""

COMPRESS_SQL = """per AS (SELECT block_id, file, string_agg(concat_ws(':', file, line_no, content), chr(10) ORDER BY line_no, place) AS text, count(*) AS k, max(of_file) AS n FROM kept GROUP BY ALL),
body AS (SELECT block_id, string_agg(concat_ws(chr(10), text, CASE WHEN n > k THEN concat('[... and ', n - k, ' more matches in ', file, ']') END), chr(10) ORDER BY file) AS body, sum(k) AS kept FROM per GROUP BY block_id),
cnt AS (SELECT block_id, count(*) AS n_matches, count(DISTINCT file) AS files FROM m GROUP BY block_id),
x AS (SELECT b.block_id, b.content, n_matches, kept, files, body, CASE WHEN n_matches >= 10 AND strlen(body)::DOUBLE / strlen(b.content) < 0.8 THEN md5(b.content)[1:24] END AS cache_key FROM search_blocks b JOIN cnt USING (block_id) JOIN body USING (block_id))
SELECT block_id, body || CASE WHEN cache_key IS NULL THEN '' ELSE concat(chr(10), '[', n_matches, ' matches compressed to ', kept, '. Retrieve more: hash=', cache_key, ']') END AS compressed, n_matches::BIGINT AS n_matches, kept::BIGINT AS kept, files::BIGINT AS files, cache_key FROM x"""
