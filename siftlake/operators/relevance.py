"""Keyword relevance with a constant inverse document frequency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
TOKEN = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[A-Za-z0-9_]+"
K1, B, IDF, TOP = 1.5, 0.75, math.log(2), 10.0


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def _terms(t: Column, q: Column, average: Column) -> tuple[Column, Column]:
    """Raw score and matched terms, in order."""
    matched = F.sort_array(F.array_intersect(F.array_distinct(q), t))

    def count(xs: Column, w: Column) -> Column:
        return F.size(F.filter(xs, lambda v: v == w))

    def one(acc: Column, w: Column) -> Column:
        f = count(t, w).cast("double")
        return acc + F.lit(IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.size(t) / average)) * count(q, w)

    return F.aggregate(matched, F.lit(0.0), one), matched


def _final(raw: Column, matched: Column) -> Column:
    bonus = F.when(F.exists(matched, lambda w: F.octet_length(w) >= 8), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.lit(1.0), raw / TOP) + bonus))


def bm25(items: DataFrame, query: Column, batch: list[str] | None = None, item: str = "item") -> DataFrame:
    """items with score, reason and matched_terms.  With batch columns the average length is the batch's, else
    each item's own."""
    x = items.withColumn("_t", tokens(F.col(item))).withColumn("_q", tokens(query))
    if batch is None:
        average = F.greatest(F.size("_t"), F.lit(1)).cast("double")
    else:
        x = x.withColumn("_a", F.avg(F.size("_t")).over(Window.partitionBy(*batch)))
        average = F.when(F.col("_a") > 0, F.col("_a")).otherwise(F.greatest(F.size("_t"), F.lit(1)))
    raw, matched = _terms(F.col("_t"), F.col("_q"), average)
    x = x.withColumn("_m", matched).withColumn("score", _final(raw, F.col("_m")))
    n = F.size("_m")
    if batch is None:
        first = F.array_join(F.slice("_m", 1, 3), ", ")
        reason = (F.when(n == 0, "BM25: no term matches").when(n == 1, F.concat(F.lit("BM25: matched '"), F.get("_m", F.lit(0)), F.lit("'")))
                  .otherwise(F.concat(F.lit("BM25: matched "), n.cast("string"), F.lit(" terms ("), first, F.when(n > 3, "...").otherwise(""), F.lit(")"))))
    else:
        reason = F.when(F.size("_q") == 0, "BM25: empty context").when(n == 0, "BM25: no matches").otherwise(F.concat(F.lit("BM25: "), n.cast("string"), F.lit(" terms")))
    cap = 10 if batch is None else 5
    return x.withColumn("reason", reason).withColumn("matched_terms", F.slice("_m", 1, cap)).drop("_t", "_q", "_m", "_a")


def hybrid(scored: DataFrame) -> DataFrame:
    """bm25's rows boosted where terms matched; embeddings aren't at hand."""
    n = F.size("matched_terms")
    low = F.greatest(F.col("score"), F.lit(0.3))
    boosted = F.when(n >= 2, F.least(F.lit(1.0), low + 0.2)).when(n == 1, low).otherwise(F.col("score"))
    return scored.withColumn("score", boosted).withColumn("reason", F.concat(F.lit("Hybrid (BM25 only, boosted): "), F.col("reason")))


def hybrid_alpha(text: Column) -> Column:
    """The weight of keywords by what the query holds: UUIDs, numbers, hosts or mail addresses."""
    uuids = F.regexp_count(text, F.lit(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"))
    ids = F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])\d{4,}(?![A-Za-z0-9_])"))
    lower = F.lower(text)
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    # fixed values: the last class of an address holds a bar
    named = lower.rlike(r"(?<![A-Za-z0-9_])[a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9-]*(?:\.[a-z]{2,})?(?![A-Za-z0-9_])") | lower.rlike(rf"{edge}[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{{2,}}{edge}")
    return F.when(uuids > 0, 0.85).when(ids >= 2, 0.75).when(ids == 1, 0.65).when(named, 0.6).otherwise(0.5)


def scorer(tier: str):
    """The scorer of a tier, "bm25" or "hybrid" in any case: a function (items, query, batch) -> items with score,
    reason and matched_terms."""
    name = tier.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    if name == "bm25":
        return bm25
    if name == "hybrid":
        return lambda items, query, batch=None, item="item": hybrid(bm25(items, query, batch, item))
    if name == "embedding":
        raise ValueError("the embedding scorer needs a model, and none is at hand")
    raise ValueError(f"unknown scorer tier {tier!r}: bm25, hybrid")
