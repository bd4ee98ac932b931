"""N-gram Jaccard self-join by vertical partitioning.

The global order of shingles (rare first, then by hash) is cut into fragments by hash range.  Each
batch of documents sends its distinct shingle hashes to the fragments, already merged within the
batch, so that a shingle of every document costs one entry a batch.  A fragment counts its part of
each document's shingles that also occur elsewhere; the parts are summed per document.  A document
with too few shared shingles to reach the threshold with anyone is settled there.

For the others, copies of one set fold into a class.  Classes that share a shingle
of their prefix (exact prefix filter over the same order) are candidates: their overlaps are counted
per fragment and summed per pair.  Within a prefix bucket each class is first compared with one pivot;
members that are then in one component need no more pairs, so a bucket of g near copies costs g pairs.
In buckets that still hold several components, the pairs between components follow, each in the first
bucket that it shares.  A parity sketch of each set bounds the symmetric difference from below, so that
only pairs that can reach the threshold leave the join; no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_SKETCH = 16  # words of 64 bits


def _parity(h: np.ndarray) -> np.ndarray:
    """Bit b is how often the set's hashes hit b, modulo 2; of two sketches, the bits that differ number at
    most the hashes that are in one set only."""
    at = C.mix(h.astype(np.uint64)) & np.uint64(64 * _SKETCH - 1)
    odd = np.bincount(at.astype(np.int64), minlength=64 * _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _shingles(texts: list[bytes], n: int):
    """Distinct shingle hashes of each text, as (text number, hash) sorted by both, and the set sizes."""
    h, counts = C.words(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    g = C.grams(h, n)
    doc_of = np.repeat(np.arange(len(texts)), counts)
    if len(g):
        whole = doc_of[: len(g)] == doc_of[n - 1 :]
        docs, hs = doc_of[: len(g)][whole], g[whole]
    else:
        docs, hs = np.empty(0, np.int64), np.empty(0, np.uint64)
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            docs = np.concatenate([docs, short])
            hs = np.concatenate([hs, C.grams(h, k)[starts[short]]])
    order = np.lexsort((hs, docs))
    docs, hs = docs[order], hs[order]
    if len(docs):
        first = np.r_[True, (docs[1:] != docs[:-1]) | (hs[1:] != hs[:-1])]
        docs, hs = docs[first], hs[first]
    return docs, hs, np.bincount(docs, minlength=len(texts))


def _send(n: int, n_frag: int, batch_rows: int, batch_bytes: int):
    layout = C.Layout(n_frag)

    def run(frames):
        key = C.batch_key()
        for pdf in C.pieces(frames, batch_rows, batch_bytes):
            ids = pdf["doc_id"].to_numpy(np.int64)
            docs, hs, size = _shingles([C.utf8(t) for t in pdf["text"]], n)
            one, two = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
            np.add.at(one, docs, C.mix(hs ^ np.uint64(0x5851F42D4C957F2D)))
            np.add.at(two, docs, C.mix(hs + np.uint64(0x14057B7EF767814F)))
            hs = layout.place(hs)
            order = np.argsort(hs, kind="stable")
            docs, hs = docs[order].astype(np.uint16), hs[order]
            new = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.empty(0, bool)
            times = np.diff(np.r_[np.flatnonzero(new), len(hs)])
            many = np.repeat(times > 1, times)
            out = [(key, -1 - (key + (key >> 24)) % n_frag, C.pack(ids, size, one, two, docs[many], hs[many]))]
            single, sdoc, mult, mtimes = hs[~many], docs[~many], hs[new][times > 1], times[times > 1].astype(np.uint32)
            none = slice(0, 0)
            ones, more = dict(layout.cuts(single)), dict(layout.cuts(mult))
            for f in sorted({*ones, *more}):
                s, m = ones.get(f, none), more.get(f, none)
                out.append((key, f, C.pack(C.squeeze_sorted(single[s]), sdoc[s], C.squeeze_sorted(mult[m]), mtimes[m])))
            yield pd.DataFrame(out, columns=["batch", "frag", "blob"])
            key += 1

    return run


def _fragment(key, pdf):
    """Which entries are shared, and by how many documents; rows about whole batches pass."""
    if key[0] < 0:
        return pdf
    parts = [C.unpack(b) for b in pdf["blob"]]
    hs = [C.unsqueeze_sorted(x) for p in parts for x in (p[0], p[2])]
    times = [t for p in parts for t in (np.ones(len(p[1]), np.uint32), p[3])]
    sizes = [len(x) for x in hs]
    h = np.concatenate(hs)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    group = np.cumsum(np.r_[0, sorted_h[1:] != sorted_h[:-1]]) if len(h) else np.empty(0, np.int64)
    total = np.bincount(group, weights=np.concatenate(times)[order]).clip(0, 65535).astype(np.uint16)
    df = np.empty(len(h), np.uint16)
    df[order] = total[group]
    at, out = 0, []
    for i, batch in enumerate(pdf["batch"]):
        a, b = at + sizes[2 * i], at + sizes[2 * i] + sizes[2 * i + 1]
        shared = np.flatnonzero(df[at:a] >= 2)
        if len(shared) or b > a:
            out.append((batch, key[0], C.pack(C.squeeze_sorted(h[at:a][shared]), parts[i][1][shared], df[at:a][shared], h[a:b], df[a:b])))
        at = b
    del parts, hs, h, order, sorted_h, group, total, df
    C.release()
    return pd.DataFrame(out, columns=["batch", "frag", "blob"])


def _gather(n_frag: int, percent: int):
    layout = C.Layout(n_frag)

    def run(key, pdf):
        docs, hs, dfs = [], [], []
        multi_h, multi_df = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)]
        ids = size = one = two = None
        for frag, blob in zip(pdf["frag"], pdf["blob"], strict=True):
            part = C.unpack(blob)
            if frag < 0:
                ids, size, one, two, mdoc, mh = part
            else:
                lead = layout.lead(frag)
                docs.append(part[1].astype(np.int64))
                hs.append(C.unsqueeze_sorted(part[0]) | lead)
                dfs.append(part[2])
                multi_h.append(part[3] | lead)
                multi_df.append(part[4])
        known, counts = np.concatenate(multi_h), np.concatenate(multi_df)
        order = np.argsort(known)
        docs.append(mdoc.astype(np.int64))
        hs.append(mh)
        dfs.append(counts[order][np.searchsorted(known[order], mh)] if len(known) else np.empty(0, np.uint16))
        doc, h, df = np.concatenate(docs), np.concatenate(hs), np.concatenate(dfs)
        order = np.lexsort((h, df, doc))
        doc, h = doc[order], h[order].astype(np.int64)
        shared = np.bincount(doc, minlength=len(ids))
        ends = np.cumsum(shared)
        need = (size * percent + 99) // 100
        rows = []
        for i in range(len(ids)):
            if size[i] and shared[i] >= need[i]:
                own = h[ends[i] - shared[i] : ends[i]]
                lead = shared[i] - need[i] + 1  # prefix length less the shingles that are this document's only
                alone = size[i] - shared[i]
                rows.append((ids[i], size[i], one[i].astype(np.int64), two[i].astype(np.int64), alone, own[:lead], _parity(own), own.tobytes()))
            else:
                rows.append((ids[i], size[i], 0, 0, 0, None, None, None))
        del docs, hs, dfs, doc, h, df, order
        C.release()
        return pd.DataFrame(rows, columns=["doc_id", "n_shingles", "f1", "f2", "alone", "lead", "bits", "own"])

    return run


def _segments(v: int):
    def run(frames):
        for pdf in frames:
            rows = []
            for cid, own in zip(pdf["cid"], pdf["own"], strict=True):
                h = np.sort(np.frombuffer(own, np.int64))
                which = h % v
                rows += [(cid, k, h[which == k].tobytes()) for k in range(v)]
            yield pd.DataFrame(rows, columns=["cid", "seg", "part"])

    return run


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), True)) for x, y in zip(a, b, strict=True)]
    return pd.Series(out, dtype="int32")


def _verify(pairs: DataFrame, segments: DataFrame, v: int, percent: int) -> DataFrame:
    """Links among pairs(a, na, b, nb): partial overlaps per fragment of the order, summed per pair."""
    spread = pairs.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(v - 1))))
    overlap = F.pandas_udf(_overlap, "int")
    left = segments.select(F.col("cid").alias("a"), "seg", F.col("part").alias("pa"))
    right = segments.select(F.col("cid").alias("b"), "seg", F.col("part").alias("pb"))
    partial = (spread.join(left, ["a", "seg"]).join(right, ["b", "seg"])
               .select("a", "b", "na", "nb", overlap("pa", "pb").alias("c")))
    return (partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
            .where(F.expr(f"100 * c >= {percent} * (na + nb - c)")).select("a", "b"))


def ngram_components(documents: DataFrame, n: int = 5, percent: int = 75, batch_rows: int = 2000,
                     batch_bytes: int = 4 << 20, verify_fragments: int = 4, named_buckets: int = 256, fragments: int = 0, bucket_split: int = 4096) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of documents(doc_id, text, ...), one per input row.

    Links: 100 * intersection >= percent * union of distinct n-word shingles (A-Z folded; words are
    runs of non-space bytes; a text of fewer words is one shingle).  Null, empty and blank texts have
    no shingles, no links and are their own component.  doc_id names a text: repeated rows are fine.  A row
    without an id names none: it links with nothing and has null in all columns.  An empty table gives no
    rows.  Other columns, whatever their names, are not read.  Memory: one batch or one fragment of the hash
    order per task.
    Classes with more than named_buckets open buckets may meet in several of them; that costs, no more.
    Open buckets of more than bucket_split classes are compared part by part.
    """
    spark = documents.sparkSession
    named_rows = C.steady(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_frag = fragments or C.fragments(spark, C.text_bytes(named_rows))
    wire = "batch long, frag long, blob binary"
    sent = named_rows.where("doc_id is not null").mapInPandas(
        _send(n, n_frag, batch_rows, batch_bytes), wire)
    told = sent.groupBy("frag").applyInPandas(_fragment, wire)
    sets = C.cut(told.groupBy("batch").applyInPandas(
        _gather(n_frag, percent),
        "doc_id long, n_shingles long, f1 long, f2 long, alone long, lead array<long>, bits array<long>, own binary"))
    live = sets.where("own is not null")
    classes = C.cut(live.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("cid")))
    reps = C.cut(live.select(F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"), "alone", "lead", "bits", "own")
                 .join(classes.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))
    segments = reps.select("cid", "own").mapInPandas(_segments(verify_fragments), "cid long, seg int, part binary")
    posts = reps.select("cid", "n", "alone", "bits", F.explode("lead").alias("g"))
    pivots = (posts.groupBy("g").agg(F.count("*").alias("c"), F.min(F.struct("cid", "n", "alone", "bits")).alias("p"))
              .where("c > 1").select(F.col("g").alias("pg"), "p.*"))

    def near(left: str, right: str) -> Column:
        differ = " + ".join(f"bit_count({left}.bits[{i}] ^ {right}.bits[{i}])" for i in range(_SKETCH))
        return F.expr(f"100 * least({left}.n, {right}.n) >= {percent} * greatest({left}.n, {right}.n) and "
                      f"{100 + percent} * ({left}.alone + {right}.alone + {differ}) <= {100 - percent} * ({left}.n + {right}.n)")

    def shape(a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.cid").alias("a"), F.col(f"{a}.n").alias("na"), F.col(f"{b}.cid").alias("b"), F.col(f"{b}.n").alias("nb")]

    pairs = C.cut(pivots.alias("x").join(posts.alias("y"), F.expr("x.pg = y.g and x.cid <> y.cid") & near("x", "y"))
                  .select(*shape("x", "y")).distinct())
    links = C.cut(_verify(pairs, segments, verify_fragments, percent))
    comps = C.components(links)
    named = (reps.select("cid", "n", "alone", "bits", "lead").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
             .withColumn("k", F.coalesce("component_id", "cid")).drop("component_id"))
    at = named.select("cid", "k", F.explode("lead").alias("g"))
    open_ = at.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("cid").alias("pivot")).where("lo <> hi").drop("lo", "hi")
    rest = C.cut(at.join(open_, "g").where("cid <> pivot").select("cid", "g"))
    opens = rest.groupBy("cid").agg(F.collect_list("g").alias("o"))  # at most the class's own prefix
    few = F.when(F.size("o") <= named_buckets, F.col("o"))
    members = C.cut(named.drop("lead").join(opens, "cid").select("cid", "n", "alone", "bits", "k", F.explode("o").alias("g"), few.alias("o")))
    # a large bucket is cut into parts by hash, and parts meet two by two, so that no task holds it whole
    parts = C.cut(rest.groupBy("g").agg(F.ceil(F.count("*") / bucket_split).alias("of")).where("of > 1"))
    members = members.join(parts, "g", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("cid"), "of"))
    upper = members.withColumn("l", F.col("c")).withColumn("r", F.explode(F.sequence(F.col("c"), F.col("of") - 1)))
    lower = members.withColumn("r", F.col("c")).withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c"))))
    meet = F.expr("x.g = y.g and x.l = y.l and x.r = y.r and (x.l < x.r or x.cid < y.cid) and x.k <> y.k")
    first = F.expr("x.o is null or y.o is null or x.g = array_min(array_intersect(x.o, y.o))")
    met = upper.alias("x").join(lower.alias("y"), meet & near("x", "y") & first).select(*shape("x", "y"))
    new = met.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                     F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    new = C.cut(new.distinct().join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti").select("a", "na", "b", "nb"))
    found = C.cut(_verify(new, segments, verify_fragments, percent))
    if found.limit(1).count():
        comps = C.components(links.union(found))
    of_class = classes.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select(
        "n_shingles", "f1", "f2", F.coalesce("component_id", "cid").alias("component_id"))
    keyed = sets.select("doc_id", "n_shingles", "f1", "f2", F.col("own").isNotNull().alias("live"))
    alone = keyed.where("not live").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = named_rows.where("doc_id is null").select("doc_id", F.col("doc_id").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return keyed.where("live").join(of_class, ["n_shingles", "f1", "f2"]).select(
        "doc_id", "n_shingles", "component_id").union(alone).union(nameless)


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """docs with one document of each component (its smallest doc_id); columns unchanged, whatever their names.

    A document that shares nothing stays, as do all rows whose text is null or blank and those without an id.
    """
    (name,) = C.fresh(docs, "gone")
    gone = ngram_components(docs, **params).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(C.cut(gone), docs["doc_id"].cast("long") == F.col(name), "left_anti")
