"""Mixing to target weights by iterative proportional fitting.

Token counts are summed over the cells of source, language and topic.  Raking scales the cells to each
marginal's targets in turn until all hold.  A cell's fitted weight over its own tokens gives the copies
that its documents should have: the whole part of them, and one more with the probability that is left,
decided by a repeatable number from the id.  So the expected marginals are the targets themselves.

A text's topic is fitted from the corpus's words: the anchors are the words that split the documents
best (the largest df * (N - df) over all documents), and a text belongs to the anchor that it holds most
often beside the anchor's document frequency.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^ \t\n\r\x0B\f]+"
TOPIC_WORD = r"\p{Ll}{3,16}"
DIMS = ["source", "lang", "topic"]


def _topic_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOPIC_WORD), 0)


def anchors(texts: DataFrame, n: int = 8) -> list[tuple[str, int]]:
    """The n words of texts(text) with the largest df * (N - df), ties by word, with their df; over all rows."""
    total = texts.count()
    df = texts.select(F.explode(F.array_distinct(_topic_words(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    rows = df.orderBy((F.col("df") * (F.lit(total) - F.col("df"))).desc(), "w").limit(n).collect()  # n rows
    return [(r["w"], r["df"]) for r in rows]


def topic(text: Column, known: list[tuple[str, int]]) -> Column:
    """The anchor with the most occurrences over df, the earlier one of equals; '' if the text holds none."""
    if not known:
        return F.lit("")
    held = F.filter(_topic_words(text), lambda x: x.isin([w for w, _ in known]))

    def count(words: Column, w: str) -> Column:
        return F.size(F.filter(words, lambda x: x == w))

    def scores(words: Column) -> Column:
        return F.array(*(F.struct((count(words, w) / F.lit(float(df))).alias("s"), F.lit(-i).alias("i"), F.lit(w).alias("w")) for i, (w, df) in enumerate(known)))

    best = F.array_max(F.element_at(F.transform(F.array(held), scores), 1))
    return F.when(best["s"] > 0, best["w"]).otherwise("")


def rake(codes: list[np.ndarray], tokens: np.ndarray, alpha: float, sweeps: int, tolerance: float) -> np.ndarray:
    """Weights of cells, raked until every marginal is within the tolerance of its targets."""
    total = tokens.sum()
    targets = []
    for c in codes:
        powers = np.bincount(c, tokens) ** alpha
        targets.append(powers / powers.sum() * total)
    weight = tokens.astype(np.float64)
    for _ in range(sweeps):
        off = 0.0
        for c, target in zip(codes, targets, strict=True):
            has = np.bincount(c, weight)
            off = max(off, float(np.abs(has / target - 1).max()))
            weight = weight * (target / has)[c]
        if off < tolerance:
            break
    return weight


def _rake_table(cells: DataFrame, dims: list[str], alpha: float, sweeps: int, tolerance: float) -> DataFrame:
    """The same over a table of cells of any size, by sums and joins; each sweep replaces the last one's table."""
    targets = {}
    for d in dims:
        own = cells.groupBy(d).agg(F.sum("tokens").alias("own")).withColumn("power", F.pow("own", F.lit(alpha)))
        all_ = own.agg(F.sum("own").alias("total"), F.sum("power").alias("powers")).first()
        scale = (all_["total"] or 0) / (all_["powers"] or 1.0)
        targets[d] = C.cut(own.select(d, (F.col("power") * scale).alias("target")))
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        before, offs = now, []
        for d in dims:
            scale = now.groupBy(d).agg(F.sum("weight").alias("has")).join(targets[d], d)
            scale = C.cut(scale.select(d, (F.col("target") / F.col("has")).alias("by")))
            offs.append(scale.agg(F.max(F.abs(F.col("by") - 1)).alias("off")).first()["off"] or 0.0)
            now = now.join(scale, d).withColumn("weight", F.col("weight") * F.col("by")).drop("by")
        now = C.cut(now.select(*dims, "tokens", "weight"))
        if before is not cells:
            C.drop(before)
        if max(offs) < tolerance:
            break
    return now


def fitted(cells: DataFrame, dims: list[str] = DIMS, alpha: float = 0.7, sweeps: int = 40, tolerance: float = 1e-10, most_local: int = 50_000) -> DataFrame:
    """cells(dims..., tokens) with weight, raked so that each dim's marginal follows its tokens' shares to
    the power alpha (all sums keep the total).  Up to most_local cells are raked as arrays on the driver;
    more stay a table."""
    local = cells.limit(most_local + 1).toPandas()  # at most most_local + 1 rows
    if len(local) > most_local:
        return _rake_table(cells, dims, alpha, sweeps, tolerance)
    tokens = local["tokens"].to_numpy(np.float64)
    codes = [pd.factorize(local[d], sort=True)[0] for d in dims]
    local["weight"] = rake(codes, tokens, alpha, sweeps, tolerance) if len(local) else tokens
    return cells.sparkSession.createDataFrame(local, ", ".join(f"{d} string" for d in dims) + ", tokens long, weight double")


def _stated(documents: DataFrame) -> DataFrame:
    return C.steady(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"),
                                      F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def expected_copies(documents: DataFrame, alpha: float = 0.7, sweeps: int = 40, least: float = 0.5, n_topics: int = 8, most_local: int = 50_000) -> DataFrame:
    """Rows (doc_id, source, lang, topic, n_tokens, copies), one per input row: how often a document belongs
    in a sample that meets all targets, in expectation.  See mixing_rates."""
    docs = _stated(documents)
    known = anchors(docs, n_topics)
    slim = C.cut(docs.select("doc_id", "source", "lang", topic(F.col("text"), known).alias("topic"),
                             F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens")))
    rates = cell_rates(slim, alpha, sweeps, least, most_local)
    return slim.join(rates, DIMS, "left").select("doc_id", *DIMS, "n_tokens", F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("copies")).alias("copies"))


def cell_rates(slim: DataFrame, alpha: float, sweeps: int, least: float, most_local: int) -> DataFrame:
    """(source, lang, topic, copies) of every cell with tokens in slim(source, lang, topic, n_tokens)."""
    cells = C.cut(slim.where("n_tokens > 0").groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    fit = fitted(cells, DIMS, alpha, sweeps, most_local=most_local).withColumn("ratio", F.col("weight") / F.col("tokens"))
    most = fit.agg(F.max("ratio")).first()[0] or 1.0
    return fit.select(*DIMS, (F.col("ratio") * max(1.0 / most, least)).alias("copies"))


def drawn(doc_id: Column, copies: Column, seed: str) -> Column:
    """How many copies are drawn: the whole part, and one more with the probability that is left."""
    whole = F.floor(copies)
    return whole + (C.hash_unit(doc_id, seed) < copies - whole).cast("long")


def mixing_rates(documents: DataFrame, seed: str = "mix", **params) -> DataFrame:
    """Rows (doc_id, source, lang, topic, n_tokens, copies, drawn, kept), one per input row.

    Tokens are words.  Targets: each marginal's token shares to the power alpha, so large sources give way
    to small ones.  The sample is scaled to the largest in which no document is wanted more than once, but
    not under `least` of all tokens in expectation; documents of cells that are wanted more often then are
    repeated.  Either way the expected marginals are the targets.  A null source or language is the
    category ''.  Texts without words weigh nothing; one copy is kept, as they change no marginal.  Equal
    rows fare alike, and an empty table gives no rows.  Other columns aren't read.  Memory: a task holds the
    words of one text at a time, about 80 bytes each.
    """
    out = expected_copies(documents, **params)
    return out.withColumn("drawn", drawn(F.col("doc_id"), F.col("copies"), seed)).withColumn("kept", F.col("drawn") > 0)


def mixed(docs: DataFrame, seed: str = "mix", alpha: float = 0.7, sweeps: int = 40, least: float = 0.5, n_topics: int = 8, most_local: int = 50_000) -> DataFrame:
    """docs sampled to the target weights, a document as often as mixing_rates draws it; columns unchanged,
    whatever their names.  Cells are looked up beside the texts, so no text is joined by id."""
    stated = _stated(docs)
    known = anchors(stated, n_topics)
    name, n, times = C.fresh(docs, "topic", "n", "times")
    label = topic(F.coalesce("text", F.lit("")), known)
    slim = C.cut(stated.select("source", "lang", topic(F.col("text"), known).alias("topic"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"))
                 .groupBy(*DIMS).agg(F.sum("n_tokens").alias("n_tokens")))
    rates = cell_rates(slim, alpha, sweeps, least, most_local)
    keys = C.fresh(docs, "k_source", "k_lang", "k_topic", "k_copies")
    rates = rates.select(*(F.col(c).alias(k) for c, k in zip([*DIMS, "copies"], keys, strict=True)))
    here = docs.withColumn(name, label).withColumn(n, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)))
    on = (F.coalesce(here["source"], F.lit("")) == F.col(keys[0])) & (F.coalesce(here["lang"], F.lit("")) == F.col(keys[1])) & (F.col(name) == F.col(keys[2]))
    copies = F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.col(keys[3]))
    found = here.join(rates, on, "left").withColumn(times, drawn(here["doc_id"].cast("long"), copies, seed)).where(F.col(times) > 0)
    return found.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def mixing_sql(alpha: float = 0.7, sweeps: int = 40, least: float = 0.5, n_topics: int = 8, seed: str = "mix") -> str:
    """The same for DuckDB."""
    word = r"[^ \t\n\r\x0B\f]+"
    ctes = [rf"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '{word}')) AS n_tokens, regexp_extract_all(coalesce(text, ''), '\p{{Ll}}{{3,16}}') AS ws FROM documents),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS w FROM d) GROUP BY w),
an AS MATERIALIZED (SELECT w, df, row_number() OVER (ORDER BY df * ((SELECT count(*) FROM d) - df) DESC, w) AS i FROM df ORDER BY i LIMIT {n_topics}),
hits AS (SELECT doc_id, w, count(*) / df::DOUBLE AS s, i FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN an USING (w) GROUP BY doc_id, w, df, i),
tp AS (SELECT doc_id, w AS topic FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) = 1),
s AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(topic, '') AS topic, n_tokens FROM d LEFT JOIN tp USING (doc_id)),
w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM s WHERE n_tokens > 0 GROUP BY ALL)"""]
    for d in DIMS:
        ctes.append(f"""t_{d} AS MATERIALIZED (SELECT {d}, pow(own, {alpha}) / sum(pow(own, {alpha})) OVER () * sum(own) OVER () AS target FROM (SELECT {d}, sum(tokens) AS own FROM w0 GROUP BY {d}))""")
    k = 0
    for _ in range(sweeps):
        for d in DIMS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * target / sum(weight) OVER (PARTITION BY {d}) AS weight FROM w{k} JOIN t_{d} USING ({d}))")
            k += 1
    return f"""WITH {", ".join(ctes)},
p AS (SELECT source, lang, topic, weight / tokens * greatest(1.0 / max(weight / tokens) OVER (), {least}) AS copies FROM w{k}),
o AS (SELECT doc_id, source, lang, topic, n_tokens, CASE WHEN n_tokens = 0 THEN 1.0::DOUBLE ELSE copies END AS copies FROM s LEFT JOIN p USING (source, lang, topic)),
x AS (SELECT *, floor(copies)::BIGINT + (('0x' || md5(doc_id::VARCHAR || '|{seed}')[1:12])::BIGINT / 281474976710656.0 < copies - floor(copies))::BIGINT AS drawn FROM o)
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(copies, 6) AS copies, drawn, drawn > 0 AS kept FROM x"""
