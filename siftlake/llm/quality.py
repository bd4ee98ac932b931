"""Quality by importance resampling.

Two generative models over hashed word n-grams: one of target text (labelled good), one of all raw text.
A document's importance weight is the ratio of their likelihoods for one of its n-grams (the geometric
mean).  As many documents as the labels call for are drawn without replacement, with odds in proportion to
weight ** strength: the k largest of strength * log weight + Gumbel noise.  The noise decides among
documents near the edge and hardly elsewhere.

Labelled documents are dealt to two halves by a hash of their ids: the target model counts one, and k is set
with the other, so that documents without labels are measured as those with labels are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def _features(texts: list[bytes], buckets: int):
    """Hash buckets of all words and word pairs, and the texts they are from."""
    h, counts = C.words(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    pairs = C.grams(h, 2)
    whole = doc[1:] == doc[:-1]
    mask = np.uint64(buckets - 1)
    return np.concatenate([doc, doc[1:][whole]]), np.concatenate([h & mask, pairs[whole] & mask]).astype(np.int64)


def _count(fit: dict[int, int], buckets: int):
    def run(frames):
        total = np.zeros((2, buckets), np.int64)
        for part in C.pieces(frames, 1000, 1 << 20):
            doc, f = _features([C.utf8(t) for t in part["text"]], buckets)
            good = np.array([fit.get(i, 0) == 1 for i in part["doc_id"].tolist()])
            total[0] += np.bincount(f, minlength=buckets)
            total[1] += np.bincount(f[good[doc]], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": at, "raw": total[0][at], "target": total[1][at]})

    return run


def _weights(texts: list[bytes], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams and mean log ratio of each text."""
    doc, f = _features(texts, len(ratio))
    n = np.bincount(doc, minlength=len(texts))
    return n, np.round(np.bincount(doc, weights=ratio[f], minlength=len(texts)) / np.maximum(n, 1), 9)


def _score(ratio: np.ndarray):
    def run(frames):
        for part in C.pieces(frames, 1000, 1 << 20):
            n, weight = _weights([C.utf8(t) for t in part["text"]], ratio)
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_grams": n, "weight": weight})

    return run


def _threshold(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The cut with the best balanced accuracy among those that keep so much of the good."""
    if not len(good):
        return -np.inf
    most = np.quantile(good, 1 - keep)
    if not len(bad):
        return float(most)
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = cuts[cuts <= most] if (cuts <= most).any() else cuts[:1]
    gain = np.searchsorted(np.sort(bad), cuts) / len(bad) - np.searchsorted(np.sort(good), cuts) / len(good)
    best = np.flatnonzero(gain == gain.max())
    at = int(best[0])
    low = bad[bad < cuts[at]]
    return float((cuts[at] + low.max()) / 2) if len(low) else float(cuts[at])


def labelled_sample(labels: DataFrame, most: int) -> tuple[dict[int, int], dict[int, int]]:
    """At most so many labelled ids in hash order, dealt to two halves: 1 for quality 1 without toxic, 0 for
    quality 0.  Of several rows for one id the least quality and the largest toxic count; quality 1 with toxic
    is neither."""
    one = (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.min(F.col("quality").cast("int")).alias("q"), F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("t")))
    rows = (one.where("q = 0 or t = 0").select("doc_id", "q", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect())  # `most` rows
    return tuple({r["doc_id"]: r["q"] for r in rows if r["half"] == half} for half in (0, 1))


def top_k(keys: DataFrame, k: int, bins: int = 4096) -> float | None:
    """The k-th largest of keys(key double) by narrowing histograms; None if there are at most k."""
    spread = keys.agg(F.count("key").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if spread["n"] <= k:
        return None
    lo, hi = spread["lo"], spread["hi"]
    above = 0
    while True:
        inside = keys.where(F.col("key").between(lo, hi))
        step = (hi - lo) / bins
        if step <= 0 or lo + step == lo:
            return hi
        at = F.least(F.floor((F.col("key") - lo) / step), F.lit(bins - 1)).alias("at")
        rows = inside.groupBy(at).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # at most bins rows
        for r in sorted(rows, key=lambda r: -r["at"]):
            if above + r["n"] >= k:
                if r["n"] == 1 or r["lo"] == r["hi"]:
                    return r["lo"]
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket, and the least key to keep (None: all)."""

    ratio: np.ndarray
    least: float | None
    strength: float
    seed: str

    def kept(self, doc_id: Column, n_grams: Column, weight: Column) -> Column:
        return F.lit(True) if self.least is None else self.key(doc_id, n_grams, weight) >= self.least

    def key(self, doc_id: Column, n_grams: Column, weight: Column) -> Column:
        noise = -F.log(-F.log(C.hash_unit(doc_id, self.seed) * (1 - 2e-12) + 1e-12))
        return F.when(n_grams > 0, weight * self.strength + noise).otherwise(F.lit(1e9))


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float) -> np.ndarray:
    """Log of the target's over the raw model's probability of each bucket.  The target's counts are joined by
    `prior` for each bucket on average, spread as the raw text is, so that rare buckets tell little."""
    if not target.sum():
        return np.zeros(len(raw))
    q = (raw + 0.5) / (raw + 0.5).sum()
    spread = prior * len(raw)
    return np.log((target + spread * q) / (target.sum() + spread)) - np.log(q)


def fit(documents: DataFrame, labels: DataFrame, buckets: int = 1 << 14, max_labelled: int = 20_000,
        strength: float = 40.0, keep_good: float = 0.995, prior: float = 2.0, seed: str = "gumbel") -> tuple[Model, DataFrame]:
    """The model, and rows (doc_id, n_grams, weight) of all documents, a scratch table.

    The raw model counts every word and word pair of all documents; the target model those of one half of at
    most max_labelled labelled ids (a bounded sample in hash order).  The other half sets k: so many documents
    are kept as have a weight above the cut with the best balanced accuracy among those that keep keep_good
    of the good.
    """
    docs = C.steady(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    taught, held = labelled_sample(labels, max_labelled)
    model = docs.mapInPandas(_count(taught, buckets), "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[model["bucket"]] = model["raw"]
    target[model["bucket"]] = model["target"]
    ratio = log_ratio(raw, target, prior)
    scored = C.cut(docs.mapInPandas(_score(ratio), "doc_id long, n_grams long, weight double"))
    spark = documents.sparkSession
    sample = F.broadcast(spark.createDataFrame(pd.DataFrame({"doc_id": [*held], "q": [*held.values()]}), "doc_id long, q int"))
    seen = scored.join(sample, "doc_id").where("n_grams > 0").groupBy("doc_id", "q").agg(F.max("weight").alias("weight")).toPandas()  # the sample
    cut_at = _threshold(seen.loc[seen.q == 1, "weight"].to_numpy(), seen.loc[seen.q == 0, "weight"].to_numpy(), keep_good)
    draft = Model(ratio, None, strength, seed)
    k = scored.where((F.col("weight") >= cut_at) | (F.col("n_grams") == 0)).count()
    least = top_k(scored.select(draft.key(F.col("doc_id"), F.col("n_grams"), F.col("weight")).alias("key")), k)
    return Model(ratio, least, strength, seed), scored


def quality_scores(documents: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Rows (doc_id, n_grams, weight, kept), one per input row; see `fit` for the parameters.  weight is the
    log of the importance weight.

    A text without words has weight 0 and no evidence against it; so has everything if neither half has a
    good label, and all is kept then.  Null texts count as empty.  Equal ids and texts fare alike, also in
    repeated rows; a null id draws its noise as the empty id.  Labels of one id that disagree count by the
    least quality and the largest toxic.  Empty tables give no rows.  Other columns, whatever their names,
    aren't read.
    """
    model, scored = fit(documents, labels, **params)
    return scored.select("doc_id", "n_grams", "weight", model.kept(F.col("doc_id"), F.col("n_grams"), F.col("weight")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs without those that quality_scores rejects; columns unchanged, whatever their names.  Texts are
    weighed again where they are, so that none is shuffled."""
    model, _ = fit(docs, labels, **params)
    ratio = model.ratio

    def weigh(texts: pd.Series) -> pd.DataFrame:
        n, weight = _weights([C.utf8(t) for t in texts], ratio)
        return pd.DataFrame({"n": n.astype(np.int64), "w": weight})

    (name,) = C.fresh(docs, "q")
    weighed = docs.withColumn(name, F.pandas_udf(weigh, "n long, w double")("text"))
    found = F.col(f"`{name}`")
    return weighed.where(model.kept(docs["doc_id"].cast("long"), found["n"], found["w"])).select(*docs.columns)
