"""Blocks derived from the tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOG = """CASE WHEN event_type = 'error' AND ((event_id {div} 100) % 2 = 1 OR event_id % 8 = 0) THEN concat('ERROR request ', event_id, ' error: upstream refused user ', user_id)
WHEN event_type = 'error' THEN concat('INFO upstream latency ok ', event_id)
WHEN event_type = 'signup' THEN concat('WARNING: retry attempt ', event_id, ' for worker ', chr((97 + user_id % 7)::{int}))
WHEN event_type = 'purchase' THEN concat('INFO processing request id=', event_id, ' user=', user_id)
WHEN event_type = 'view' THEN concat('DEBUG heartbeat tick ', user_id % 7)
WHEN event_id % 10 = 3 THEN concat('  File "app.py", line ', event_id, ', in handler')
WHEN event_id % 10 = 7 THEN concat('=== summary of shard ', user_id % 4)
ELSE 'INFO click accepted' END"""


def joined(lines: DataFrame, *order: str) -> DataFrame:
    """(block_id, content) from lines(block_id, order..., line)."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy("block_id").agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("content"))


def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.expr(_LOG.format(div="div", int="INT").replace("concat(", "concat('', "))
    return joined(e.select(F.expr("event_id div 100").alias("block_id"), "event_id", line.alias("line")), "event_id")


LOG_SQL = f"""log_blocks AS (SELECT event_id // 100 AS block_id, string_agg({_LOG.format(div='//', int='INT')}, chr(10) ORDER BY event_id) AS content FROM events GROUP BY 1)"""


def search_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    line = F.expr("concat('docs/', source, '/d', doc_id % 5, '.txt:', i + 1, ':', CASE doc_id % 7 WHEN 0 THEN 'error: ' WHEN 1 THEN 'warning ' WHEN 2 THEN 'TODO ' ELSE '' END, x)")
    return joined(d.select(F.expr("doc_id div 20").alias("block_id"), "doc_id", "i", line.alias("line")), "doc_id", "i")


SEARCH_SQL = """search_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
search_blocks AS (SELECT doc_id // 20 AS block_id, string_agg(concat('docs/', source, '/d', doc_id % 5, '.txt:', i, ':', CASE doc_id % 7 WHEN 0 THEN 'error: ' WHEN 1 THEN 'warning ' WHEN 2 THEN 'TODO ' ELSE '' END, x), chr(10) ORDER BY doc_id, i) AS content FROM search_lines GROUP BY 1)"""


def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    line = F.expr("""concat('{\n  "brand": "', p_brand, '",\n  "key": ', p_partkey, ',\n  "size": ', p_size, '\n}')""")
    rows = p.select(F.expr("p_partkey div 20").alias("block_id"), "p_partkey", line.alias("line"))
    pairs = F.sort_array(F.collect_list(F.struct("p_partkey", "line")))
    return rows.groupBy("block_id").agg(F.concat(F.lit("[ "), F.array_join(F.transform(pairs, lambda x: x["line"]), ", "), F.lit(" ]")).alias("content"))


JSON_SQL = """json_blocks AS (SELECT p_partkey // 20 AS block_id, concat('[ ', string_agg(concat('{', chr(10), '  "brand": "', p_brand, '",', chr(10), '  "key": ', p_partkey, ',', chr(10), '  "size": ', p_size, chr(10), '}'), ', ' ORDER BY p_partkey), ' ]') AS content FROM part GROUP BY 1)"""


_DIFF_PATH = "CASE file_no WHEN 1 THEN 'go.sum' ELSE concat('src/mod_', file_no, '.py') END"


def diff_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = (table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderpriority as p", "o_orderkey div 60 as block_id",
                                                  "(o_orderkey % 60) div 12 as file_no", "o_orderkey % 12 as hunk_no")
         .selectExpr("*", f"{_DIFF_PATH} as path", "10 * hunk_no + 1 as s", "row_number() over (partition by block_id, file_no order by k) as nth"))
    return joined(o.selectExpr("block_id", "k", f"{_HUNK} as line"), "k").withColumn("content", F.concat("content", F.lit("\n")))


_HUNK = r"""concat(CASE WHEN nth = 1 THEN concat('diff --git a/', path, ' b/', path, '{nl}--- a/', path, '{nl}+++ b/', path, '{nl}') ELSE '' END,
'@@ -', s, ',10 +', s, ',10 @@ fn_', k, '{nl}', repeat(concat(' ctx ', c, '{nl}'), 4), '-old total ', k, '{nl}',
CASE WHEN file_no = 2 THEN concat('+old  total ', k) ELSE concat('+new total ', k, CASE WHEN p LIKE '1%' THEN ' fix auth' ELSE '' END) END, '{nl}', repeat(concat(' ctx ', c, '{nl}'), 3), ' ctx ', c)""".replace("{nl}", "\n")

DIFF_SQL = f"""diff_rows AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderkey // 60 AS block_id, (o_orderkey % 60) // 12 AS file_no, o_orderkey % 12 AS hunk_no, 10 * (o_orderkey % 12) + 1 AS s FROM orders),
diff_named AS (SELECT *, {_DIFF_PATH} AS path, row_number() OVER (PARTITION BY block_id, file_no ORDER BY k) AS nth FROM diff_rows),
diff_blocks AS (SELECT block_id, string_agg({_HUNK}, chr(10) ORDER BY k) || chr(10) AS content FROM diff_named GROUP BY 1)"""


_EDGE_FILE = r"""CASE f % 6
WHEN 0 THEN concat('diff --git a/f', f, '.txt b/f', f, '.txt{nl}index 1..2{nl}--- a/f', f, '.txt{nl}+++ b/f', f, '.txt{nl}@@ -1,8 +1,9 @@ part{nl}', repeat(' far{nl}', 4), ' near{nl}-old ', k, '{nl}', repeat(concat('+new ', c, '{nl}'), (1 + c % 5)::{int}), repeat(' after{nl}', 4), '\ No newline at end of file')
WHEN 1 THEN concat('diff --git a/f', f, '.txt b/g', f, '.txt{nl}similarity index 90%{nl}rename from f', f, '.txt{nl}rename to g', f, '.txt')
WHEN 2 THEN concat('diff --git a/n', f, ' b/n', f, '{nl}new file mode 100755{nl}--- /dev/null{nl}+++ b/n', f, '{nl}@@ -0,0 +1,2 @@{nl}+first ', k, '{nl}+todo ', c)
WHEN 3 THEN concat('diff --git a/i', f, '.png b/i', f, '.png{nl}index 1..2{nl}Binary files a/i', f, '.png and b/i', f, '.png differ')
WHEN 4 THEN concat('diff --cc m', f, '{nl}--- a/m', f, '{nl}+++ b/m', f, '{nl}@@@ -7,2 -8,2 +', 9 + c % 3, ',3 @@@ both{nl}  same{nl}++merged ', k, '{nl} -gone{nl}- gone too{nl}  same')
ELSE concat('diff --combined d', f, '{nl}deleted file mode 100644{nl}@@@@ -1,3 -2,3 -3,3 +0,0 @@@@{nl}---', k, '{nl}@@ -5,4 +5,4 @@{nl}', repeat(' still{nl}', 3), ' still') END"""


def edge_diff_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of 30 files each in all the forms that a file may take, after a line that belongs to none."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderkey div 30 as block_id", "o_orderkey % 30 as f")
    text = _EDGE_FILE.replace("{nl}", "\n").replace("{int}", "INT").replace("'\\ No", "'\\\\ No")
    return joined(o.selectExpr("block_id", "k", f"{text} as line"), "k").withColumn("content", F.concat(F.lit("From a mail\n\n"), "content"))


EDGE_DIFF_SQL = f"""edge_diff_blocks AS (SELECT block_id, concat('From a mail', chr(10), chr(10), string_agg({_EDGE_FILE.replace('{nl}', chr(10)).replace('{int}', 'INT')}, chr(10) ORDER BY k)) AS content
 FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 30 AS block_id, o_orderkey % 30 AS f FROM orders) GROUP BY block_id)"""
