"""The queries over the driver tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SearchConfig
from .functions import detect, scalars
from .functions.text import split_lines, split_plain
from .operators import diff, log, reformat, relevance, search, tags
from .plans import condense
from .sources import corpora, store

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [corpora.table(spark, sf_dir, t).select(F.lit(c).alias("corpus"), F.expr(f"cast({i} as string)").alias("id"), F.col(x).alias("content"))
             for t, c, i, x in (("documents", "documents", "doc_id", "text"), ("pages", "pages", "page_id", "html"), ("benchmark", "benchmark", "item_id", "text"),
                                ("conversations", "conversations", "concat(conv_id, '/', turn)", "text"), ("events", "events", "event_id", "props"))]
    parts += [f(spark, sf_dir).select(F.lit(c).alias("corpus"), F.col("block_id").cast("string").alias("id"), "content")
              for c, f in (("log", corpora.log_blocks), ("diff", corpora.diff_blocks), ("search", corpora.search_blocks), ("json", corpora.json_blocks))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_RAW = f"""{corpora.LOG_SQL}, {corpora.DIFF_SQL}, {corpora.SEARCH_SQL}, {corpora.JSON_SQL},
raw_blocks AS (SELECT 'documents' AS corpus, doc_id::VARCHAR AS id, text AS content FROM documents UNION ALL SELECT 'pages', page_id::VARCHAR, html FROM pages UNION ALL SELECT 'benchmark', item_id::VARCHAR, text FROM benchmark
 UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 'events', event_id::VARCHAR, props FROM events
 UNION ALL SELECT 'log', block_id::VARCHAR, content FROM log_blocks UNION ALL SELECT 'diff', block_id::VARCHAR, content FROM diff_blocks UNION ALL SELECT 'search', block_id::VARCHAR, content FROM search_blocks UNION ALL SELECT 'json', block_id::VARCHAR, content FROM json_blocks)"""


@_query(f"WITH {_RAW} SELECT corpus, id, {detect.content_type_sql('content')} AS content_type FROM raw_blocks")
def detect_type(spark, sf_dir):
    return _raw(spark, sf_dir).select("corpus", "id", detect.content_type(F.col("content")).alias("content_type"))


@_query(f"WITH {_RAW} SELECT corpus, {detect.content_type_sql('content')} AS content_type, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM raw_blocks GROUP BY ALL")
def type_histogram(spark, sf_dir):
    x = _raw(spark, sf_dir).select("corpus", detect.content_type(F.col("content")).alias("content_type"), F.octet_length("content").alias("b"))
    return x.groupBy("corpus", "content_type").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


_DOC_LINES = log.LINES_SQL.format(blocks="(SELECT doc_id AS block_id, text AS content FROM documents) q")


@_query(f"WITH {_DOC_LINES} SELECT block_id AS doc_id, line_no, md5(line) AS digest FROM lines", "split_lines")
def split_lines_query(spark, sf_dir):
    d = corpora.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long"), F.md5("line").alias("digest"))


@_query("SELECT doc_id, i - 1 AS line_no, md5(x) AS digest FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))", "split_plain")
def split_plain_query(spark, sf_dir):
    d = corpora.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(split_plain(F.col("text"))).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long"), F.md5("line").alias("digest"))


@_query("SELECT doc_id, greatest(1, floor(length(text) / 4.0::DOUBLE + 0.5))::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return corpora.table(spark, sf_dir, "documents").select("doc_id", scalars.token_estimate(F.col("text")).alias("tokens"))


@_query("SELECT lang, sum(greatest(1, floor(length(text) / 4.0::DOUBLE + 0.5)))::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY lang")
def token_by_lang(spark, sf_dir):
    d = corpora.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.sum(scalars.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


_MODELS = ["gpt-4o", "gpt-4o-mini", "o1-preview", "o3", "gpt-4", "gpt-4-turbo", "gpt-3.5-turbo", "GPT-4o", "other", ""]


@_query(f"SELECT m AS model, CASE WHEN regexp_matches(lower(m), '^(gpt-4o|o1|o3)') THEN 'o200k_base' WHEN regexp_matches(lower(m), '^(gpt-4|gpt-3\\.5)') THEN 'cl100k_base' ELSE 'estimator' END AS tokenizer FROM (SELECT unnest({_MODELS}) AS m)")
def model_tokenizer(spark, sf_dir):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, _MODELS))).alias("model")).select("model", scalars.model_tokenizer(F.col("model")).alias("tokenizer"))


@_query("SELECT doc_id, md5(text)[1:24] AS key FROM documents")
def ccr_key_md5(spark, sf_dir):
    return corpora.table(spark, sf_dir, "documents").select("doc_id", scalars.key_md5(F.col("text")).alias("key"))


@_query("SELECT doc_id, sha256(text)[1:24] AS key FROM documents")
def ccr_key_strong(spark, sf_dir):
    return corpora.table(spark, sf_dir, "documents").select("doc_id", scalars.key_strong(F.col("text")).alias("key"))


@_query("SELECT doc_id, '<<ccr:' || md5(text)[1:24] || '>>' AS marker FROM documents")
def marker_build(spark, sf_dir):
    return corpora.table(spark, sf_dir, "documents").select("doc_id", scalars.marker(scalars.key_md5(F.col("text"))).alias("marker"))


_MARK = "CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END || '<<ccr:' || {} || CASE WHEN doc_id % 5 = 0 THEN '0' ELSE '' END || '>>'"


@_query(f"SELECT doc_id, nullif(regexp_extract({_MARK.format('md5(text)[1:24]')}, '^<<ccr:([0-9a-f]{{24}})>>$', 1), '') AS key FROM documents")
def marker_parse(spark, sf_dir):
    d = corpora.table(spark, sf_dir, "documents")
    return d.select("doc_id", scalars.marker_key(F.expr(_MARK.format("substring(md5(cast(text as binary)), 1, 24)"))).alias("key"))


@_query("SELECT doc_id, concat('<<ccr:', md5(text)[1:24], ',', lang, ',', strlen(text), '>>') AS cell, concat('<<ccr:', md5(text)[1:24], ' ', n_chars, '_rows_offloaded>>') AS lossy FROM documents")
def marker_kinds(spark, sf_dir):
    d, key = corpora.table(spark, sf_dir, "documents"), scalars.key_md5(F.col("text"))
    return d.select("doc_id", scalars.cell_marker(key, F.col("lang"), F.octet_length("text")).alias("cell"), scalars.lossy_marker(key, F.col("n_chars")).alias("lossy"))


_CR_LINES = log.LINES_SQL.format(blocks="(SELECT doc_id AS block_id, replace(text, chr(10), chr(13) || chr(10)) || chr(13) AS content FROM documents) q")


@_query(f"WITH {_CR_LINES} SELECT block_id AS doc_id, line_no, md5(line) AS kept, md5(CASE WHEN line[-1:] = chr(13) THEN line[:-2] ELSE line END) AS stripped FROM lines")
def split_lines_cr(spark, sf_dir):
    """Lines that end in CR LF, and a last one in CR alone: kept there, or stripped."""
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", F.arrays_zip(split_lines(text).alias("kept"), split_lines(text, True).alias("stripped")).alias("z"))
    x = d.select("doc_id", F.posexplode("z").alias("line_no", "z"))
    return x.select("doc_id", F.col("line_no").cast("long"), F.md5("z.kept").alias("kept"), F.md5("z.stripped").alias("stripped"))


_LOG_LINES = f"{corpora.LOG_SQL}, {log.LINES_SQL.format(blocks='log_blocks')}"


def _signals(context: str) -> None:
    if context == "diff":
        sql = f"WITH {corpora.DIFF_SQL}, {log.LINES_SQL.format(blocks='diff_blocks')}"
        blocks = corpora.diff_blocks
    elif context == "search":
        sql = f"WITH {corpora.SEARCH_SQL}, {log.LINES_SQL.format(blocks='search_blocks')}"
        blocks = corpora.search_blocks
    else:
        sql, blocks = f"WITH {_LOG_LINES}", corpora.log_blocks

    def run(spark, sf_dir):
        x = blocks(spark, sf_dir).select("block_id", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))
        s = scalars.signal(F.col("line"), context)
        return x.select("block_id", F.col("line_no").cast("long"), s.alias("s")).select("block_id", "line_no", F.col("s.category").alias("category"), F.round(F.col("s.priority").cast("double"), 4).alias("priority"))

    _query(f"""{sql}, c AS (SELECT block_id, line_no, {scalars.importance_sql('line', context)} AS category FROM lines)
SELECT block_id, line_no, category, CASE category WHEN 'error' THEN 0.95 WHEN 'security' THEN 0.85 WHEN 'warning' THEN 0.75 WHEN 'importance' THEN 0.6 WHEN 'markdown' THEN 0.45 ELSE 0 END::DOUBLE AS priority FROM c""", f"signal_score_{context}")(run)


for _c in ("text", "log", "search", "diff"):
    _signals(_c)


_TIERS = "CASE WHEN contains(line, 'worker') THEN 'worker' WHEN {kind} IS NOT NULL THEN {kind} WHEN contains(line, 'shard') THEN 'shard' END"


@_query(f"WITH {_LOG_LINES} SELECT block_id, line_no, {_TIERS.format(kind=scalars.importance_sql('line', 'log'))} AS category FROM lines")
def signal_tiers(spark, sf_dir):
    """A sure detector, the default one, and an unsure one that counts where nothing else matches."""
    def naming(word: str, confidence: float):
        def detect_(line, context):
            hit = F.contains(line, F.lit(word))
            return F.struct(F.when(hit, word).alias("category"), F.when(hit, 0.5).otherwise(0.0).cast("float").alias("priority"), F.when(hit, confidence).otherwise(0.0).cast("float").alias("confidence"))

        return detect_

    x = corpora.log_blocks(spark, sf_dir).select("block_id", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))
    detector = scalars.tiers(naming("shard", 0.3), naming("worker", 0.9), scalars.signal)
    return x.select("block_id", F.col("line_no").cast("long"), detector(F.col("line"), "log")["category"].alias("category"))


@_query(f"WITH {_LOG_LINES} SELECT block_id, line_no, regexp_matches(lower(line), '{'|'.join(scalars.INDICATORS)}') AS hit FROM lines")
def error_indicator(spark, sf_dir):
    x = corpora.log_blocks(spark, sf_dir).select("block_id", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))
    return x.select("block_id", F.col("line_no").cast("long"), scalars.error_indicator(F.col("line")).alias("hit"))


@_query(f"WITH {_DOC_LINES} SELECT block_id AS doc_id, {scalars.adaptive_k_sql('count(*)', 'count(DISTINCT line)', 5, 100)} AS k FROM lines GROUP BY block_id")
def adaptive_k(spark, sf_dir):
    x = corpora.table(spark, sf_dir, "documents").select("doc_id", split_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    return x.select("doc_id", scalars.adaptive_k(F.size("lines"), F.size(F.array_distinct("lines")), 5, 100).alias("k"))


@_query(f"WITH {_DOC_LINES} SELECT block_id AS doc_id, CASE WHEN count(*) <= 8 THEN count(*) WHEN count(DISTINCT line) <= 3 THEN least(greatest(5, count(DISTINCT line)), 40) ELSE greatest(5, least(greatest(5, floor(greatest(5, floor(count(*) * (0.3::DOUBLE + 0.7::DOUBLE * (count(DISTINCT line)::DOUBLE / count(*))))) * 1.5)), 40)) END::BIGINT AS k FROM lines GROUP BY block_id")
def adaptive_k_bias(spark, sf_dir):
    x = corpora.table(spark, sf_dir, "documents").select("doc_id", split_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    return x.select("doc_id", scalars.adaptive_k(F.size("lines"), F.size(F.array_distinct("lines")), 5, 40, 1.5).alias("k"))


@_query(f"WITH {_LOG_LINES}, {log.CLASS_SQL} SELECT block_id, line_no, level, is_stack, is_summary, score FROM scored")
def log_classify(spark, sf_dir):
    return log.log_lines(corpora.log_blocks(spark, sf_dir)).select("block_id", F.col("line_no").cast("long"), "level", "is_stack", "is_summary", "score")


@_query(f"WITH {_LOG_LINES}, {log.CLASS_SQL} SELECT block_id, {log.KEY_SQL} AS key, count(*) AS n, min(line_no) AS first_line FROM scored WHERE level = 'warn' GROUP BY ALL")
def log_warning_dedupe(spark, sf_dir):
    x = log.log_lines(corpora.log_blocks(spark, sf_dir)).where("level = 'warn'")
    return x.groupBy("block_id", log.warning_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"), F.min(F.col("line_no").cast("long")).alias("first_line"))


@_query(f"WITH {_LOG_LINES}, {log.CLASS_SQL}, {log.SELECT_SQL} SELECT block_id, line_no, keep FROM selected")
def log_select(spark, sf_dir):
    return log.log_selected(corpora.log_blocks(spark, sf_dir)).select("block_id", F.col("line_no").cast("long"), "keep")


@_query(f"WITH {_LOG_LINES}, {log.CLASS_SQL}, {log.SELECT_SQL}, {log.COMPRESS_SQL.format(blocks='log_blocks')}")
def log_compress(spark, sf_dir):
    return log.log_compress(corpora.log_blocks(spark, sf_dir))


def _log_bloat_sql(blocks: str) -> str:
    return f"""WITH {log.LINES_SQL.format(blocks=blocks)}, s AS (SELECT block_id, line, coalesce({scalars.importance_sql('line', 'log')}, '') AS c FROM lines WHERE line_no < 100), n AS (SELECT block_id, count(*) AS n FROM lines GROUP BY 1)
SELECT block_id, round(CASE WHEN max(n.n) >= 50 THEN (0.5::DOUBLE * (1 - count(DISTINCT line)::DOUBLE / count(*)) + 0.5::DOUBLE * (count(*) FILTER (c = '')::DOUBLE / count(*)))::FLOAT ELSE 0 END::DOUBLE, 5) AS bloat FROM s JOIN n USING (block_id) GROUP BY block_id"""


@_query(f"WITH {corpora.LOG_SQL} SELECT * FROM ({_log_bloat_sql('log_blocks')})")
def log_bloat(spark, sf_dir):
    return corpora.log_blocks(spark, sf_dir).select("block_id", F.round(log.log_bloat(F.col("content")).cast("double"), 5).alias("bloat"))


@_query(f"WITH {corpora.LOG_SQL} SELECT * FROM ({reformat.template_sql('log_blocks')})")
def log_template(spark, sf_dir):
    return corpora.log_blocks(spark, sf_dir).select("block_id", reformat.log_template(F.col("content")).alias("output"))


_QUERY = "error oner the"
_SEARCH = f"{corpora.SEARCH_SQL}, {search.matches_sql([w for w in _QUERY.split() if len(w) > 2])}"


@_query(f"WITH {_SEARCH} SELECT block_id, seq, file, line_no::BIGINT AS line_no, content, score FROM m", "search_parse")
def search_parse(spark, sf_dir):
    x = search.search_matches(corpora.search_blocks(spark, sf_dir), _QUERY)
    return x.select("block_id", F.col("seq").cast("long"), "file", F.col("line_no").cast("long"), "content", "score")


_KEYWORDS = ("Eren", "oner")


@_query(f"WITH {corpora.SEARCH_SQL}, {search.matches_sql([w for w in _QUERY.split() if len(w) > 2], _KEYWORDS)} SELECT block_id, seq, score FROM m", "search_score")
def search_score(spark, sf_dir):
    x = search.search_matches(corpora.search_blocks(spark, sf_dir), _QUERY, SearchConfig(keywords=_KEYWORDS))
    return x.select("block_id", F.col("seq").cast("long"), "score")


@_query(f"WITH {_SEARCH}, {search.SELECT_SQL} SELECT block_id, file, line_no::BIGINT AS line_no, content, place FROM kept")
def search_select(spark, sf_dir):
    x = search.search_selected(corpora.search_blocks(spark, sf_dir), _QUERY)
    return x.select("block_id", "file", F.col("line_no").cast("long"), "content", F.col("place").cast("long"))


@_query(f"WITH {_SEARCH}, {search.SELECT_SQL}, {search.COMPRESS_SQL}")
def search_compress(spark, sf_dir):
    return search.search_compress(corpora.search_blocks(spark, sf_dir), _QUERY)


@_query(rf"""WITH {corpora.SEARCH_SQL}, r AS (SELECT block_id, regexp_extract(trim(unnest(string_split(content, chr(10)))), '(?s)^(.*?\d)[:\-]', 1) AS p FROM search_blocks)
SELECT block_id, round(CASE WHEN count(*) FILTER (p <> '') >= 10 THEN greatest(0, least(1, (count(*) FILTER (p <> '')::DOUBLE / count(DISTINCT p) FILTER (p <> '') - 1) / 10))::FLOAT ELSE 0 END::DOUBLE, 5) AS bloat FROM r GROUP BY block_id""")
def search_bloat(spark, sf_dir):
    return corpora.search_blocks(spark, sf_dir).select("block_id", F.round(search.search_bloat(F.col("content")).cast("double"), 5).alias("bloat"))


@_query(f"WITH {corpora.JSON_SQL} SELECT block_id, json(content)::VARCHAR AS output FROM json_blocks")
def json_minify(spark, sf_dir):
    return corpora.json_blocks(spark, sf_dir).select("block_id", reformat.json_minify(F.col("content")).alias("output"))


@_query(rf"""WITH {corpora.JSON_SQL}, n AS (SELECT block_id, content, len(regexp_extract_all(content, '\}},\{{')) + len(regexp_extract_all(content, '\}}, \{{')) + len(regexp_extract_all(content, '\}},\n')) AS n FROM json_blocks)
SELECT block_id, round(CASE WHEN n >= 4 AND starts_with(trim(content), '[') THEN least(1.0::DOUBLE, n / 49.0::DOUBLE)::FLOAT ELSE 0 END::DOUBLE, 5) AS bloat FROM n""")
def json_bloat(spark, sf_dir):
    return corpora.json_blocks(spark, sf_dir).select("block_id", F.round(scalars.json_bloat(F.col("content")).cast("double"), 5).alias("bloat"))


_KINDS = "element_at(array('tool_use', 'text', 'tool_result', 'thinking', 'compaction', 'image'), cast(turn % 6 as int) + 1)"


@_query("""WITH k AS (SELECT conv_id, turn, ['tool_use', 'text', 'tool_result', 'thinking', 'compaction', 'image'][turn % 6 + 1] AS kind FROM conversations)
SELECT conv_id, turn, kind, kind IN ('tool_use', 'thinking', 'redacted_thinking', 'compaction') AS hot, CASE kind WHEN 'tool_result' THEN 'content' WHEN 'text' THEN 'text' END AS field FROM k""")
def toolpair_plan(spark, sf_dir):
    k = corpora.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_KINDS).alias("kind"))
    return k.select("*", scalars.hot_block(F.col("kind")).alias("hot"), scalars.inner_field(F.col("kind")).alias("field"))


def _puts(spark, sf_dir) -> DataFrame:
    return corpora.table(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.col("props")).alias("content"), F.col("event_id").alias("seq"), F.expr("event_id div 10").alias("at"))


_PUTS = "p AS (SELECT md5(event_type || props)[1:24] AS hash, event_type || props AS payload, event_id AS seq, event_id // 10 AS put_at FROM events), e AS (SELECT hash, arg_max(payload, seq) AS payload, min(seq) AS seq, max(put_at) AS put_at FROM p GROUP BY hash)"


@_query(f"WITH {_PUTS}, k AS (SELECT hash FROM p UNION SELECT md5('never ' || payload)[1:24] FROM p) SELECT e.hash, e.payload FROM k JOIN e USING (hash)")
def store_roundtrip(spark, sf_dir):
    puts = _puts(spark, sf_dir)
    keys = puts.select(scalars.key_md5(F.col("content")).alias("hash"))
    never = puts.select(scalars.key_md5(F.concat(F.lit("never "), "content")).alias("hash"))
    return store.get(store.entries(puts), keys.union(never))


@_query(f"WITH {_PUTS} SELECT hash, payload, seq FROM e ORDER BY seq DESC LIMIT 50")
def store_fifo(spark, sf_dir):
    return store.first_in_first_out(store.entries(_puts(spark, sf_dir)), 50).select("hash", "payload", "seq")


@_query(f"WITH {_PUTS} SELECT hash, payload FROM e WHERE put_at + 30 > (SELECT max(put_at) FROM e)")
def store_ttl(spark, sf_dir):
    e = store.entries(_puts(spark, sf_dir))
    now = e.agg(F.max("at")).first()[0]
    return store.alive(e, now, 30).select("hash", "payload")


def _items(spark, sf_dir) -> DataFrame:
    c = corpora.table(spark, sf_dir, "conversations")
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("query"))
    return c.select("conv_id", "turn", F.col("text").alias("item")).join(first, "conv_id")


_BM25 = """it AS (SELECT c.conv_id, c.turn, regexp_extract_all(lower(c.text), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|[A-Za-z0-9_]+') AS t, regexp_extract_all(lower(q.text), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|[A-Za-z0-9_]+') AS q FROM conversations c JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = 0),
av AS (SELECT *, {avg} AS av FROM it),
tf AS (SELECT conv_id, turn, w, count(*) AS f FROM (SELECT conv_id, turn, unnest(t) AS w FROM it) GROUP BY ALL),
qf AS (SELECT conv_id, turn, w, count(*) AS qf FROM (SELECT conv_id, turn, unnest(q) AS w FROM it) GROUP BY ALL),
sc AS (SELECT conv_id, turn, sum(ln(2) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / av)) * qf) AS raw, count(*) AS n, max(strlen(w)) >= 8 AS long FROM tf JOIN qf USING (conv_id, turn, w) JOIN av USING (conv_id, turn) GROUP BY ALL),
fin AS (SELECT conv_id, turn, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE least(1.0, least(1.0, raw / 10) + CASE WHEN long THEN 0.3 ELSE 0 END) END::DOUBLE AS score FROM av LEFT JOIN sc USING (conv_id, turn))"""


@_query(f"WITH {_BM25.format(avg='greatest(len(t), 1)::DOUBLE')} SELECT conv_id, turn, round(score, 6) AS score, n::BIGINT AS matched FROM fin")
def bm25_single(spark, sf_dir):
    x = relevance.bm25(_items(spark, sf_dir), F.col("query"))
    n = F.size(F.array_intersect(F.array_distinct(relevance.tokens(F.col("query"))), relevance.tokens(F.col("item"))))
    return x.select("conv_id", "turn", F.round("score", 6).alias("score"), n.cast("long").alias("matched"))


@_query(f"WITH {_BM25.format(avg='avg(len(t)) OVER (PARTITION BY conv_id)')} SELECT conv_id, turn, round(score, 6) AS score, CASE WHEN n = 0 THEN 'BM25: no matches' ELSE 'BM25: ' || n || ' terms' END AS reason FROM fin")
def bm25_batch(spark, sf_dir):
    return relevance.bm25(_items(spark, sf_dir), F.col("query"), ["conv_id"]).select("conv_id", "turn", F.round("score", 6).alias("score"), "reason")


@_query(f"WITH {_BM25.format(avg='avg(len(t)) OVER (PARTITION BY conv_id)')} SELECT conv_id, turn, round(CASE WHEN n >= 2 THEN least(1.0, greatest(score, 0.3) + 0.2) WHEN n = 1 THEN greatest(score, 0.3) ELSE score END::DOUBLE, 6) AS score FROM fin")
def hybrid_score(spark, sf_dir):
    return relevance.hybrid(relevance.bm25(_items(spark, sf_dir), F.col("query"), ["conv_id"])).select("conv_id", "turn", F.round("score", 6).alias("score"))


@_query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') THEN 0.85
 WHEN len(regexp_extract_all(text, '\b\d{4,}\b')) >= 2 THEN 0.75 WHEN regexp_matches(text, '\b\d{4,}\b') THEN 0.65
 WHEN regexp_matches(lower(text), '\b[a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9-]*(\.[a-z]{2,})?\b') OR regexp_matches(lower(text), '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b') THEN 0.6 ELSE 0.5 END::DOUBLE AS alpha FROM documents""")
def hybrid_alpha(spark, sf_dir):
    return corpora.table(spark, sf_dir, "documents").select("doc_id", relevance.hybrid_alpha(F.col("text")).alias("alpha"))


@_query(f"WITH {_BM25.format(avg='avg(len(t)) OVER (PARTITION BY conv_id)')} SELECT conv_id, turn, round(score, 6) AS score FROM fin QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 6) DESC, turn) <= 3")
def relevance_topk(spark, sf_dir):
    from pyspark.sql import Window

    x = bm25_batch(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "turn")
    return x.withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "turn", "score")


_DIFF_LINES = f"{corpora.DIFF_SQL}, {log.LINES_SQL.format(blocks='diff_blocks')}"


@_query(f"WITH {_DIFF_LINES}, {diff.PARSE_SQL} SELECT block_id, file_no::BIGINT AS file_no, path, body_lines, body_bytes, reason FROM files")
def diff_parse_files(spark, sf_dir):
    return diff.diff_files(corpora.diff_blocks(spark, sf_dir))


def _noise_bloat_sql(blocks: str) -> str:
    return f"""WITH {log.LINES_SQL.format(blocks=blocks)}, {diff.PARSE_SQL}, n AS (SELECT block_id, count(*) AS n FROM lines GROUP BY 1)
SELECT block_id, round(CASE WHEN max(n) >= 30 AND sum(body_bytes) > 0 THEN (coalesce(sum(body_bytes) FILTER (reason IS NOT NULL), 0)::DOUBLE / sum(body_bytes))::FLOAT ELSE 0 END::DOUBLE, 5) AS bloat FROM files JOIN n USING (block_id) GROUP BY block_id"""


@_query(f"WITH {corpora.DIFF_SQL} SELECT * FROM ({_noise_bloat_sql('diff_blocks')})")
def diff_noise_bloat(spark, sf_dir):
    return diff.diff_noise_bloat(corpora.diff_blocks(spark, sf_dir)).select("block_id", F.round(F.col("bloat").cast("double"), 5).alias("bloat"))


def _noise_apply_sql(blocks: str) -> str:
    return f"""WITH {log.LINES_SQL.format(blocks=blocks)}, {diff.PARSE_SQL}, j AS (SELECT f1.*, reason, body_lines, in_body AND reason IS NOT NULL AS gone, row_number() OVER (PARTITION BY f1.block_id, f1.file_no, in_body ORDER BY line_no) AS nth FROM f1 LEFT JOIN files USING (block_id, file_no)),
t AS (SELECT block_id, string_agg(CASE WHEN gone THEN concat('[diff_noise: ', reason, ' hunks dropped (', body_lines, ' lines)]') ELSE line END, chr(10) ORDER BY line_no) || chr(10) AS text, max(gone::INT) = 1 AND max(file_no) > 0 AS ok FROM j WHERE NOT coalesce(gone, false) OR nth = 1 GROUP BY block_id),
y AS (SELECT block_id, text || chr(10) || '[diff_noise CCR: hash=' || md5(content)[1:24] || ']' AS output, md5(content)[1:24] AS cache_key, coalesce(ok, false) AND strlen(text) < strlen(content) AS ok FROM {blocks} LEFT JOIN t USING (block_id))
SELECT block_id, CASE WHEN ok THEN output END AS output, CASE WHEN ok THEN cache_key END AS cache_key FROM y"""


@_query(f"WITH {corpora.DIFF_SQL} SELECT * FROM ({_noise_apply_sql('diff_blocks')})")
def diff_noise_apply(spark, sf_dir):
    return diff.diff_noise_apply(corpora.diff_blocks(spark, sf_dir))


def _diff_bloat_sql(blocks: str) -> str:
    return f"""WITH {log.LINES_SQL.format(blocks=blocks)}, k AS (SELECT block_id, line_no, line, CASE WHEN starts_with(line, '@@') THEN 1 WHEN starts_with(line, 'diff --git') THEN 0 END AS mark FROM lines),
m AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY line_no), 0) = 1 AND mark IS NULL AND NOT starts_with(line, '+++') AND NOT starts_with(line, '---') AS inside FROM k),
a AS (SELECT block_id, count(*) AS n, count(*) FILTER (inside AND starts_with(line, ' ')) AS c, count(*) FILTER (inside AND regexp_matches(line, '^[+\\-]')) AS d FROM m GROUP BY block_id)
SELECT block_id, round(CASE WHEN n >= 50 AND c + d > 0 THEN greatest(0, least(1, (c::DOUBLE / (c + d) - 0.6::DOUBLE) / 0.4::DOUBLE))::FLOAT ELSE 0 END::DOUBLE, 5) AS bloat FROM a"""


@_query(f"WITH {corpora.DIFF_SQL} SELECT * FROM ({_diff_bloat_sql('diff_blocks')})")
def diff_bloat(spark, sf_dir):
    return diff.diff_bloat(corpora.diff_blocks(spark, sf_dir)).select("block_id", F.round(F.col("bloat").cast("double"), 5).alias("bloat"))


def _tagged(spark, sf_dir) -> DataFrame:
    c = corpora.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("block_id"), "turn", F.concat(F.lit("<turn-"), "role", F.lit(">"), "text", F.lit("</turn-"), "role", F.lit(">")).alias("line"))
    return corpora.joined(c, "turn").withColumn("content", F.concat("content", F.lit("\n<meta-info/>")))


_TURNS = """t AS (SELECT conv_id AS block_id, turn, '<turn-' || role || '>' AS open_, text, '</turn-' || role || '>' AS close_, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
e AS (SELECT DISTINCT block_id, n FROM t)"""
_COUNTS = "(2 * n + 1)::INT AS seen, 0 AS html, {custom}::INT AS custom, 1 AS self_closing, 0 AS orphans, false AS collision"


def _shown(protected: DataFrame) -> DataFrame:
    pairs = F.transform("blocks", lambda b: F.concat(b["placeholder"], F.lit("="), b["original"]))
    return protected.select("block_id", "p.*").withColumn("blocks", F.array_join(pairs, "\n"))


@_query(f"""WITH {_TURNS}, x AS (SELECT block_id, string_agg(concat('{{{{KEPT_TAG_', i, '}}}}'), chr(10) ORDER BY i) AS text, string_agg(concat('{{{{KEPT_TAG_', i, '}}}}=', open_, text, close_), chr(10) ORDER BY i) AS blocks FROM t GROUP BY block_id)
SELECT block_id, concat(text, chr(10), '{{{{KEPT_TAG_', n, '}}}}') AS text, concat(blocks, chr(10), '{{{{KEPT_TAG_', n, '}}}}=<meta-info/>') AS blocks, {_COUNTS.format(custom='n')} FROM x JOIN e USING (block_id)""")
def tag_protect_block(spark, sf_dir):
    return _shown(_tagged(spark, sf_dir).select("block_id", tags.protect_tags(F.col("content")).alias("p")))


@_query(f"""WITH {_TURNS}, x AS (SELECT block_id, string_agg(concat('{{{{KEPT_TAG_', 2 * i, '}}}}', text, '{{{{KEPT_TAG_', 2 * i + 1, '}}}}'), chr(10) ORDER BY i) AS text,
 string_agg(concat('{{{{KEPT_TAG_', 2 * i, '}}}}=', open_, chr(10), '{{{{KEPT_TAG_', 2 * i + 1, '}}}}=', close_), chr(10) ORDER BY i) AS blocks FROM t GROUP BY block_id)
SELECT block_id, concat(text, chr(10), '{{{{KEPT_TAG_', 2 * n, '}}}}') AS text, concat(blocks, chr(10), '{{{{KEPT_TAG_', 2 * n, '}}}}=<meta-info/>') AS blocks, {_COUNTS.format(custom='0')} FROM x JOIN e USING (block_id)""")
def tag_protect_marker(spark, sf_dir):
    return _shown(_tagged(spark, sf_dir).select("block_id", tags.protect_tags(F.col("content"), True).alias("p")))


@_query(f"WITH {_TURNS} SELECT block_id, concat('{{{{KEPT_TAG_0}}}}', chr(10), '{{{{KEPT_TAG_', n, '}}}}') AS missing FROM e")
def tag_missing(spark, sf_dir):
    p = _tagged(spark, sf_dir).select("block_id", tags.protect_tags(F.col("content")).alias("p"))
    last = F.element_at("p.blocks", -1)["placeholder"]
    lossy = F.replace(F.replace("p.text", F.lit("{{KEPT_TAG_0}}"), F.lit("")), last, F.lit(""))
    return p.select("block_id", F.array_join(tags.missing_tags(lossy, F.col("p.blocks")), "\n").alias("missing"))


@_query("SELECT conv_id AS block_id, string_agg('<turn-' || role || '>' || text || '</turn-' || role || '>', chr(10) ORDER BY turn) || chr(10) || '<meta-info/>' AS content FROM conversations GROUP BY conv_id")
def tag_restore_roundtrip(spark, sf_dir):
    p = _tagged(spark, sf_dir).select("block_id", tags.protect_tags(F.col("content"), True).alias("p"))
    return p.select("block_id", tags.restore_tags(F.col("p.text"), F.col("p.blocks")).alias("content"))


def _plain_diff_sql(blocks: str) -> str:
    return f"""pl AS (SELECT block_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT block_id, string_split(content, chr(10)) AS p FROM {blocks})),
h0 AS (SELECT *, regexp_matches(line, '^diff (--git a/.+ b/.+|--combined .+|--cc .+)$') AS head FROM pl),
h00 AS (SELECT *, sum(head::INT) OVER (PARTITION BY block_id ORDER BY line_no) AS file_no FROM h0),
h1 AS (SELECT * EXCLUDE head, CASE WHEN file_no = 0 THEN 'pre' WHEN head THEN 'header' WHEN regexp_matches(line, '^--- (a/.+|/dev/null)$') THEN 'old' WHEN regexp_matches(line, '^\\+\\+\\+ (b/.+|/dev/null)$') THEN 'new'
 WHEN regexp_matches(line, '^(@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@|@@@ (-\\d+(,\\d+)? ){{2}}\\+\\d+(,\\d+)? @@@|@@@@ (-\\d+(,\\d+)? ){{3}}\\+\\d+(,\\d+)? @@@@)') THEN 'hunk' ELSE 'body' END AS kind FROM h00),
h2 AS (SELECT *, sum((kind = 'hunk')::INT) OVER (PARTITION BY block_id, file_no ORDER BY line_no) AS hunk_no FROM h1),
hk AS (SELECT block_id, file_no, hunk_no, max(line) FILTER (kind = 'hunk') AS header, count(*) FILTER (kind = 'body' AND starts_with(line, '+') AND NOT starts_with(line, '+++')) AS a, count(*) FILTER (kind = 'body' AND starts_with(line, '-') AND NOT starts_with(line, '---')) AS d,
 bool_or(kind = 'body' AND regexp_matches(lower(line), '(^|[^A-Za-z0-9_])({diff.PRIORITY})([^A-Za-z0-9_]|$)')) AS urgent FROM h2 WHERE hunk_no > 0 AND kind IN ('hunk', 'body') GROUP BY ALL),
hs AS (SELECT *, regexp_extract(header, '\\+(\\d+)', 1)::BIGINT AS start, round(least(0.3::DOUBLE, (a + d) * 0.03::DOUBLE) + CASE WHEN urgent THEN 0.3::DOUBLE ELSE 0 END, 2) AS score FROM hk)"""


_PLAIN_DIFF = f"{corpora.DIFF_SQL}, {_plain_diff_sql('diff_blocks')}"


@_query(f"WITH {_PLAIN_DIFF} SELECT block_id, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, header, start, a AS additions, d AS deletions, score FROM hs")
def diff_hunk_score(spark, sf_dir):
    return diff.diff_hunks(corpora.diff_blocks(spark, sf_dir))


_HUNKS_CHOSEN = f"""n1 AS (SELECT *, count(*) OVER (PARTITION BY block_id, file_no) AS n FROM hs),
n2 AS (SELECT *, hunk_no = 1 OR hunk_no = n AS edge, row_number() OVER (PARTITION BY block_id, file_no, hunk_no = 1 OR hunk_no = n ORDER BY score DESC, hunk_no) AS rank FROM n1),
n3 AS (SELECT *, n <= 10 OR edge OR rank <= 8 AS kept, CASE WHEN n <= 10 THEN 0 ELSE start END AS o1, CASE WHEN n <= 10 THEN hunk_no WHEN hunk_no = 1 THEN 0 WHEN hunk_no = n THEN 10 ELSE rank END AS o2 FROM n2),
b0 AS (SELECT *, regexp_matches(line, '^[+\\-]') AS change FROM h2 WHERE kind = 'body' AND hunk_no > 0),
b01 AS (SELECT *, bool_or(change) OVER (PARTITION BY block_id, file_no, hunk_no) AS changes FROM b0),
b1 AS (SELECT *, CASE WHEN changes THEN max(change::INT) OVER w = 1 OR starts_with(line, '\\') ELSE row_number() OVER (PARTITION BY block_id, file_no, hunk_no ORDER BY line_no) <= 2 END AS near, row_number() OVER (PARTITION BY block_id, file_no, hunk_no ORDER BY line_no) AS pos FROM b01 WINDOW w AS (PARTITION BY block_id, file_no, hunk_no ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def _diff_compress_sql(blocks: str) -> str:
    return f"""WITH {_plain_diff_sql(blocks)}, {_HUNKS_CHOSEN},
fl AS (SELECT block_id, file_no, max(line) FILTER (kind = 'header') AS header, arg_max(line, line_no) FILTER (kind = 'old') AS old, arg_max(line, line_no) FILTER (kind = 'new') AS new, bool_or(starts_with(line, 'new file mode')) AS fresh,
 bool_or(starts_with(line, 'deleted file mode')) AS dropped, bool_or(regexp_matches(line, '^Binary files .+ differ$')) AS bin FROM h2 WHERE file_no > 0 GROUP BY ALL),
fs AS (SELECT block_id, file_no, sum(a) AS a, sum(d) AS d, count(*) FILTER (NOT kept) AS gone FROM n3 GROUP BY ALL),
fa AS (SELECT fl.*, coalesce(a, 0) AS a, coalesce(d, 0) AS d, coalesce(gone, 0) AS gone FROM fl LEFT JOIN fs USING (block_id, file_no)),
fo AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY block_id) > 20 THEN row_number() OVER (PARTITION BY block_id ORDER BY a + d DESC, file_no) ELSE file_no END AS o FROM fa QUALIFY o <= 20),
rows_ AS (SELECT block_id, 0 AS o, 0 AS k, 0 AS o1, 0 AS o2, line_no AS p, line FROM h2 WHERE kind = 'pre' UNION ALL SELECT block_id, o, 1, 0, 0, 0, header FROM fo
 UNION ALL SELECT block_id, o, 2, 0, 0, line_no, line FROM h2 JOIN fo USING (block_id, file_no) WHERE regexp_matches(line, '^(rename|similarity|copy|dissimilarity) ')
 UNION ALL SELECT block_id, o, 3, 0, 0, 0, CASE WHEN fresh THEN 'new file mode 100644' ELSE 'deleted file mode 100644' END FROM fo WHERE fresh OR dropped UNION ALL SELECT block_id, o, 4, 0, 0, 0, 'Binary files differ' FROM fo WHERE bin
 UNION ALL SELECT block_id, o, 5, 0, 0, 0, old FROM fo WHERE NOT bin AND old IS NOT NULL UNION ALL SELECT block_id, o, 6, 0, 0, 0, new FROM fo WHERE NOT bin AND new IS NOT NULL
 UNION ALL SELECT n3.block_id, o, 7, o1, o2, 0, n3.header FROM n3 JOIN fo USING (block_id, file_no) WHERE kept AND NOT bin
 UNION ALL SELECT b1.block_id, o, 7, o1, o2, pos, line FROM b1 JOIN n3 USING (block_id, file_no, hunk_no) JOIN fo USING (block_id, file_no) WHERE kept AND near AND NOT bin),
tx AS (SELECT block_id, string_agg(line, chr(10) ORDER BY o, k, o1, o2, p) AS text FROM rows_ GROUP BY block_id),
su AS (SELECT block_id, count(*) AS files, sum(a) AS additions, sum(d) AS deletions, sum(gone)::BIGINT AS hunks_removed FROM fo GROUP BY block_id),
ou AS (SELECT block_id, content, len(string_split(content, chr(10))) AS n_lines, su.* EXCLUDE block_id, concat(text, chr(10), '[', files, ' files changed, +', additions, ' -', deletions, ' lines', CASE WHEN hunks_removed > 0 THEN concat(', ', hunks_removed, ' hunks omitted') ELSE '' END, ']') AS text FROM {blocks} JOIN tx USING (block_id) JOIN su USING (block_id)),
mk AS (SELECT *, len(string_split(text, chr(10))) AS m FROM ou)
SELECT block_id, text || CASE WHEN m < n_lines * 0.8 THEN concat(chr(10), '[', n_lines, ' lines compressed to ', m, '. Retrieve full diff: hash=', md5(content)[1:24], ']') ELSE '' END AS compressed, n_lines, files, additions::BIGINT AS additions, deletions::BIGINT AS deletions, hunks_removed, CASE WHEN m < n_lines * 0.8 THEN md5(content)[1:24] END AS cache_key FROM mk"""


_EDGE_DIFF = f"{corpora.EDGE_DIFF_SQL}, {_plain_diff_sql('edge_diff_blocks')}"


@_query(f"WITH {_EDGE_DIFF} SELECT block_id, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, header, start, a AS additions, d AS deletions, score FROM hs")
def diff_edge_hunks(spark, sf_dir):
    return diff.diff_hunks(corpora.edge_diff_blocks(spark, sf_dir))


@_query(f"WITH {corpora.EDGE_DIFF_SQL} SELECT * FROM ({_diff_compress_sql('edge_diff_blocks')})")
def diff_edge_compress(spark, sf_dir):
    """Diffs of many files: renames, modes, binaries, combined headers, no-newline lines, hunks without changes."""
    return diff.diff_compress(corpora.edge_diff_blocks(spark, sf_dir))


@_query(f"WITH {_PLAIN_DIFF} SELECT block_id, line_no, kind, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, md5(line) AS digest FROM h2 WHERE hunk_no > 0 AND kind IN ('hunk', 'body')")
def diff_parse_hunks(spark, sf_dir):
    x = diff.hunk_lines(corpora.diff_blocks(spark, sf_dir)).where("hunk_no > 0 and kind in ('hunk', 'body')")
    return x.select("block_id", F.col("line_no").cast("long"), "kind", "file_no", "hunk_no", F.md5("line").alias("digest"))


@_query(f"WITH {_PLAIN_DIFF}, {_HUNKS_CHOSEN} SELECT block_id, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, score, kept FROM n3")
def diff_select(spark, sf_dir):
    return diff.diff_selected(corpora.diff_blocks(spark, sf_dir))


@_query(f"WITH {_PLAIN_DIFF}, {_HUNKS_CHOSEN} SELECT block_id, line_no, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, line FROM b1 WHERE near")
def diff_trim_context(spark, sf_dir):
    return diff.diff_trimmed(corpora.diff_blocks(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


@_query(f"WITH {corpora.DIFF_SQL} SELECT * FROM ({_diff_compress_sql('diff_blocks')})")
def diff_compress(spark, sf_dir):
    return diff.diff_compress(corpora.diff_blocks(spark, sf_dir))


def _all_blocks(spark, sf_dir) -> DataFrame:
    return _raw(spark, sf_dir).select(F.concat_ws("/", "corpus", "id").alias("block_id"), "content")


def _gated(blocks: str, bloat: str, ratio: str) -> str:
    """(block_id, content) of the blocks whose replacement may run."""
    return f"(SELECT block_id, content FROM {blocks} JOIN ({bloat}) USING (block_id) WHERE bloat >= 0.5 OR ({ratio} > 0.85 AND bloat > 0))"


_PIPELINE = f"""{_RAW}, typed AS MATERIALIZED (SELECT corpus || '/' || id AS block_id, content, {detect.content_type_sql('content')} AS content_type FROM raw_blocks),
build0 AS MATERIALIZED (SELECT block_id, content FROM typed WHERE content_type = 'build'),
build1 AS MATERIALIZED (SELECT block_id, b.content AS before, coalesce(output, b.content) AS content, output IS NOT NULL AS templated FROM build0 b LEFT JOIN ({reformat.template_sql('build0')}) USING (block_id)),
build2 AS MATERIALIZED {_gated('build1', _log_bloat_sql('build1'), 'strlen(content) / strlen(before)::DOUBLE')},
build3 AS MATERIALIZED (WITH {log.LINES_SQL.format(blocks='build2')}, {log.CLASS_SQL}, {log.SELECT_SQL}, {log.COMPRESS_SQL.format(blocks='build2')}),
build AS (SELECT block_id, before, CASE WHEN ok THEN compressed ELSE content END AS output, concat_ws(',', CASE WHEN templated THEN 'log_template' END, CASE WHEN ok THEN 'log_offload' END) AS steps, CASE WHEN ok THEN cache_key ELSE '' END AS cache_keys
 FROM (SELECT *, coalesce(cache_key IS NOT NULL AND strlen(compressed) < strlen(content), false) AS ok FROM build1 LEFT JOIN build3 USING (block_id))),
diff0 AS MATERIALIZED (SELECT block_id, content FROM typed WHERE content_type = 'diff'),
diff1 AS MATERIALIZED {_gated('diff0', _noise_bloat_sql('diff0'), '1')},
diff2 AS MATERIALIZED (SELECT block_id, d.content AS before, CASE WHEN ok THEN output ELSE d.content END AS content, CASE WHEN ok THEN cache_key END AS key1
 FROM (SELECT d.block_id, d.content, output, cache_key, coalesce(strlen(output) < strlen(d.content), false) AS ok FROM diff0 d LEFT JOIN ({_noise_apply_sql('diff1')}) USING (block_id)) d),
diff3 AS MATERIALIZED {_gated('diff2', _diff_bloat_sql('diff2'), '1')},
diff4 AS MATERIALIZED ({_diff_compress_sql('diff3')}),
diffs AS (SELECT block_id, before, CASE WHEN ok THEN compressed ELSE content END AS output, concat_ws(',', CASE WHEN key1 IS NOT NULL THEN 'diff_noise' END, CASE WHEN ok THEN 'diff_offload' END) AS steps, concat_ws(',', key1, CASE WHEN ok THEN cache_key END) AS cache_keys
 FROM (SELECT *, coalesce(cache_key IS NOT NULL AND strlen(compressed) < strlen(content), false) AS ok FROM diff2 LEFT JOIN diff4 USING (block_id))),
jsons AS (SELECT block_id, content AS before, CASE WHEN strlen(m) < strlen(content) THEN m ELSE content END AS output, CASE WHEN strlen(m) < strlen(content) THEN 'json_minifier' ELSE '' END AS steps, '' AS cache_keys
 FROM (SELECT *, json(content)::VARCHAR AS m FROM typed WHERE content_type = 'json_array')),
others AS (SELECT block_id, content AS before, content AS output, '' AS steps, '' AS cache_keys FROM typed WHERE content_type NOT IN ('build', 'diff', 'json_array')),
done AS (SELECT block_id, content_type, output, (strlen(before) - strlen(output))::BIGINT AS bytes_saved, steps, cache_keys FROM (SELECT * FROM build UNION ALL SELECT * FROM diffs UNION ALL SELECT * FROM jsons UNION ALL SELECT * FROM others) JOIN typed USING (block_id))"""


def _condensed(spark, sf_dir) -> DataFrame:
    x = condense.condense(_all_blocks(spark, sf_dir))
    return x.withColumn("steps", F.array_join("steps", ",")).withColumn("cache_keys", F.array_join("cache_keys", ","))


@_query(f"WITH {_PIPELINE} SELECT block_id, content_type, output, bytes_saved, steps, cache_keys FROM done")
def pipeline_compress(spark, sf_dir):
    return _condensed(spark, sf_dir)


@_query(f"WITH {_PIPELINE} SELECT content_type, count(*) AS n, sum(bytes_saved)::BIGINT AS bytes_saved, sum(len(regexp_extract_all(cache_keys, '[0-9a-f]{{24}}')))::BIGINT AS replaced FROM done GROUP BY content_type")
def pipeline_stats(spark, sf_dir):
    x = condense.condense(_all_blocks(spark, sf_dir))
    return x.groupBy("content_type").agg(F.count("*").alias("n"), F.sum("bytes_saved").alias("bytes_saved"), F.sum(F.size("cache_keys")).alias("replaced"))
