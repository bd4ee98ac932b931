"""The thin queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cdc, embedding_dedup, media, mixing, ngram_join, quality, sharding, sparse_suffix, token_counts
from .common import read_table

#: Where the vocabulary files lie; a parameter, never a copy in the repository.
TOKENIZERS = os.environ.get("SIFTLAKE_TOKENIZERS")


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeated_substrings(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mixing_rates(read_table(spark, sf_dir, "documents"))
    return rates.withColumn("copies", F.round("copies", 6))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(read_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(read_table(spark, sf_dir, "embeddings"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.audio_features(media.encode_audio(read_table(spark, sf_dir, "documents"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_ngram_join, op3_substring_dedup, op4_mixing, op5_quality, op6_sharding,
                                    op7_token_counts, op8_suffix_dedup, op9_embedding_dedup, op10_media)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP2 = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n FROM g),
p AS (SELECT doc_id, md5(unnest(gs)) AS h FROM g),
s AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
q AS MATERIALIZED (SELECT p.doc_id, p.h FROM p JOIN s USING (h)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM q a JOIN q b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(r.c), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n"""

_OP8 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(ws) - 44)) AS p, unnest([md5(array_to_string(ws[i + 1:i + 45], ' ')) FOR i IN range(0, len(ws) - 44)]) AS h FROM w WHERE len(ws) >= 45),
f AS (SELECT h, min((doc_id, p)) AS first FROM g GROUP BY h HAVING count(*) > 1),
d AS (SELECT g.doc_id, g.p, f.first[1] AS src FROM g JOIN f USING (h) WHERE (g.doc_id, g.p) <> f.first),
b AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 45 THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b)
SELECT doc_id, min(p)::BIGINT AS start_word, (max(p) + 45)::BIGINT AS end_word, arg_min(src, p) AS first_doc_id FROM r GROUP BY doc_id, run"""

_OP9 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95),
r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
m AS (SELECT id AS vec_id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.c, vec_id)) AS kept
FROM embeddings LEFT JOIN k USING (vec_id) LEFT JOIN m USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": _OP2, "op4_mixing": mixing.mixing_sql(), "op8_suffix_dedup": _OP8, "op9_embedding_dedup": _OP9}
