"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are turned into the principal axes, largest first.  A tree of median cuts along those axes
deals them into tiles of bounded size, and successive tiles into bands.  Bands are compared two by two, so a
vector travels once for each band that its own can meet, not for each tile.  Bands and tiles whose bounding
boxes are too far apart can't hold a pair.  For other tiles the products of the leading dimensions are
summed first; what the rest can add is at most the product of the suffix norms, which rides along as one
more dimension, and pairs that can't reach the threshold stop there.  The others go on over more and more
dimensions.  Survivors are settled with the given components in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _matrix(column, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros, which changes no product."""
    out = np.zeros((len(column), width))
    for row, x in zip(out, column, strict=True):
        row[: len(x)] = x
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # scaled first: no overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(width: int):
    def run(frames):
        total = np.zeros((width, width))
        for pdf in frames:
            if len(pdf):
                u = _unit(_matrix(pdf["embedding"], width))
                total += u.T @ u
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "v": total.reshape(-1)})

    return run


def _tree(sample: np.ndarray, leaves: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree of median cuts along the widest of the leading axes: axis and value of each node."""
    depth = max(0, math.ceil(math.log2(max(leaves, 1))))
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    rows = {0: np.arange(len(sample))}
    for node in range((1 << depth) - 1):
        at = rows.pop(node)
        own = sample[at]
        right = np.zeros(len(at), bool)
        if len(at) > 1:
            axis[node] = int(own[:, :axes].var(axis=0).argmax())
            value[node] = float(np.median(own[:, axis[node]]))
            right = own[:, axis[node]] > value[node]
        rows[2 * node + 1], rows[2 * node + 2] = at[~right], at[right]
    return axis, value


def _leaf(u: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.zeros(len(u), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (u[np.arange(len(u)), axis[node]] > value[node])
    return node - len(axis)


def _deal(basis: np.ndarray, axis: np.ndarray, value: np.ndarray):
    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(leaf=_leaf(_unit(_matrix(pdf["embedding"], len(basis))) @ basis, axis, value))

    return run


def _band(basis: np.ndarray, kind: str, tile: int):
    """The vectors of a band, tile by tile, and its bounding box along the axes."""

    def run(key, pdf):
        pdf = pdf.sort_values(["leaf", "chunk", "cid"])
        x = _matrix(pdf["embedding"], len(basis))
        u = _unit(x) @ basis
        starts = pdf["leaf"].to_numpy() * (1 << 20) + pdf["chunk"].to_numpy()
        begin = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1]])
        blob = C.pack(pdf["cid"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), pdf["embedding"].map(len).to_numpy(np.int32), begin, x.astype(kind).reshape(-1))
        return pd.DataFrame([{"band": key[0], "lo": u.min(axis=0), "hi": u.max(axis=0), "blob": blob}])

    return run


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of each component of n nodes under edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Band:
    """A band's vectors, turned to the axes, with the leading dimensions and the suffix norm as one matrix."""

    def __init__(self, blob: bytes, basis: np.ndarray, lead: int) -> None:
        self.cid, self.copies, self.size, begin, flat = C.unpack(blob)
        self.x = flat.astype(np.float64).reshape(len(self.cid), -1)
        self.u = _unit(self.x) @ basis
        self.tiles = [*zip(begin.tolist(), [*begin[1:].tolist(), len(self.cid)], strict=True)]
        self.boxes = [(self.u[a:b].min(axis=0), self.u[a:b].max(axis=0)) for a, b in self.tiles]
        self.lead = np.concatenate([self.u[:, :lead], self.suffix(lead)[:, None]], axis=1).astype(np.float32)

    def suffix(self, start: int) -> np.ndarray:
        return np.sqrt((self.u[:, start:] ** 2).sum(axis=1))


def close_pairs(p: Band, a: int, b: int, q: Band, c: int, d: int, cosine: float, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of p[a:b] and q[c:d] with cosine at least so much."""
    width = p.u.shape[1]
    # single precision here: the margin is over its error
    hit = np.flatnonzero((p.lead[a:b] @ q.lead[c:d].T).reshape(-1) >= np.float32(cosine - 1e-4))
    r, s = hit // (d - c) + a, hit % (d - c) + c
    done = lead
    part = _dots(p.u[:, :done], q.u[:, :done], r, s)
    while done < width and len(r):
        to = min(width, 2 * done)
        part = part + _dots(p.u[:, done:to], q.u[:, done:to], r, s)
        left = part + p.suffix(to)[r] * q.suffix(to)[s] >= cosine - 1e-9
        r, s, part, done = r[left], s[left], part[left], to
    x, y = p.x / np.abs(p.x).max(axis=1, keepdims=True) if len(r) else p.x, q.x / np.abs(q.x).max(axis=1, keepdims=True) if len(r) else q.x
    nx, ny = (np.sqrt((z * z).sum(axis=1)) for z in (x, y))
    ok = (_dots(x, y, r, s) / (nx[r] * ny[s]) >= cosine) & (p.size[r] == q.size[s])
    return r[ok], s[ok]


def _dots(x: np.ndarray, y: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Products of the rows r of x and s of y, in blocks."""
    return np.concatenate([np.einsum("ij,ij->i", x[r[i : i + 65536]], y[s[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.empty(0)])


def _compare(basis: np.ndarray, cosine: float, lead: int):
    """Links within or between two bands: for each vector how many copies it links to, and edges that span
    their components."""
    far = 2 - 2 * cosine + 1e-6

    def run(key, pdf):
        i, j = key
        blobs = dict(zip(pdf["band"], pdf["blob"], strict=True))
        p = Band(blobs[i], basis, lead)
        q = p if i == j else Band(blobs[j], basis, lead)
        n = len(p.cid)
        add = [np.zeros(len(p.cid), np.int64), np.zeros(len(q.cid), np.int64)]
        edges = [np.empty((0, 2), np.int64)]
        for k, (a, b) in enumerate(p.tiles):
            for m, (c, d) in enumerate(q.tiles):
                if i == j and m < k:
                    continue
                (lo, hi), (lo2, hi2) = p.boxes[k], q.boxes[m]
                if (np.maximum(0, np.maximum(lo - hi2, lo2 - hi)) ** 2).sum() > far:
                    continue
                r, s = close_pairs(p, a, b, q, c, d, cosine, lead)
                if i == j and k == m:
                    r, s = r[r < s], s[r < s]
                if not len(r):
                    continue
                np.add.at(add[0], r, q.copies[s])
                np.add.at(add[1], s, p.copies[r])
                nodes, at = np.unique(np.concatenate([r, s + (0 if i == j else n)]), return_inverse=True)
                edges.append(np.stack([nodes, nodes[_roots(at[: len(r)], at[len(r) :], len(nodes))]], axis=1))
        edge = np.concatenate(edges)
        if i == j:
            cid, total = p.cid, add[0] + add[1]
        else:
            cid, total = np.concatenate([p.cid, q.cid]), np.concatenate(add)
        order = np.argsort(cid, kind="stable")
        rank = np.empty(len(cid), np.int64)
        rank[order] = np.arange(len(cid))
        root = order[_roots(rank[edge[:, 0]], rank[edge[:, 1]], len(cid))][rank]
        at = np.flatnonzero(total)
        return pd.DataFrame({"a": cid[at], "add": total[at], "b": cid[root[at]]})

    return run


def _near(boxes: DataFrame, far: float, width: int) -> DataFrame:
    """Pairs (i, j) of bands, i <= j, whose boxes are near enough for a pair: by cells of the leading axes."""
    wide = math.sqrt(far)
    cells = boxes
    spread = boxes.select(F.col("band").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    keys = []
    for k in range(min(2, width)):
        cells = cells.withColumn(f"c{k}", F.explode(F.sequence(F.floor(F.col("lo")[k] / wide), F.floor(F.col("hi")[k] / wide))))
        spread = spread.withColumn(f"c{k}", F.explode(F.sequence(F.floor(F.col("lo2")[k] / wide) - 1, F.floor(F.col("hi2")[k] / wide) + 1)))
        keys.append(f"c{k}")
    gap = F.expr("aggregate(zip_with(zip_with(lo, hi, (l, h) -> named_struct('l', l, 'h', h)), zip_with(lo2, hi2, (l, h) -> named_struct('l', l, 'h', h)), "
                 "(p, q) -> pow(greatest(0d, p.l - q.h, q.l - p.h), 2d)), 0d, (a, v) -> a + v)")
    return cells.join(spread, keys).where("band <= j").where(gap <= far).select(F.col("band").alias("i"), "j").distinct()


def _links(own: DataFrame, width: int, kind: str, cosine: float, tile: int, band: int, sample: int, axes: int) -> DataFrame:
    """(a, add, b) of all classes own(embedding, cid, copies) of at most `width` components."""
    spark = own.sparkSession
    total = own.count()
    basis = np.eye(width)
    if width <= 4096:  # the moments are width * width numbers, whatever the rows
        moments = own.select("embedding").mapInPandas(_moments(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        second = np.zeros((width, width))
        second[moments["i"], moments["j"]] = moments["v"]
        basis = np.linalg.eigh((second + second.T) / 2)[1][:, ::-1].copy()
    some = own.orderBy(F.xxhash64("cid")).limit(sample).select("embedding").toPandas()
    u = _unit(_matrix(some["embedding"], width)) @ basis
    axis, value = _tree(u, -(-total // tile), axes)
    rest = 1 - np.cumsum((u * u).mean(axis=0))
    lead = int(np.searchsorted(-rest, -0.75)) + 1  # so many that the rest holds three quarters on average
    leaves = len(axis) + 1
    n_bands = max(-(-total // band), min(leaves, math.ceil(math.sqrt(6 * C.shuffle_partitions(spark)))))
    dealt = C.cut(own.mapInPandas(_deal(basis, axis, value), "embedding array<double>, cid long, copies long, leaf long"))
    per = dealt.groupBy("leaf").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / tile))
    each = max(1, band // tile)  # chunks of a crowded leaf that one band takes
    bands = C.cut(dealt.join(per, "leaf").withColumn("chunk", chunk)
                  .withColumn("band", F.floor(F.col("leaf") * n_bands / leaves) + F.floor(F.col("chunk") / each) * n_bands)
                  .groupBy("band").applyInPandas(_band(basis, kind, tile), "band long, lo array<double>, hi array<double>, blob binary"))
    pairs = C.cut(_near(bands.select("band", "lo", "hi"), 2 - 2 * cosine + 1e-6, width))
    sides = bands.select("band", "blob")
    sent = sides.join(pairs, F.col("band") == F.col("i")).union(sides.join(pairs.where("i < j"), F.col("band") == F.col("j")))
    return C.cut(sent.groupBy("i", "j").applyInPandas(_compare(basis, cosine, lead), "a long, add long, b long"))


def embedding_links(embeddings: DataFrame, cosine: float = 0.95, tile: int = 1024, band: int = 1 << 16, sample: int = 20_000, axes: int = 8) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per input row: how many other vectors have a cosine
    of at least `cosine` (exact, in double precision), the smallest vec_id reachable, and whether it is that.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
    different length don't link.  Equal vectors are compared once, with their number of copies.  Other
    columns, whatever their names, aren't read.  At most `sample` vectors shape the tiles; all are compared.
    vec_id names a vector; a row without one links with nothing and has null component_id and kept.  An
    empty table gives no rows.  Lengths are compared together that share a power of two, so there are few passes.
    """
    kind = "f4" if "float" in embeddings.schema["embedding"].dataType.simpleString() else "f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) <= 1.7976931348623157e308 and abs(v) < double('Infinity')) and exists(embedding, v -> v <> 0)")
    ok = rows.where(good)
    bad = rows.where(~F.coalesce(good, F.lit(False)))
    classes = C.cut(ok.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")))
    size = F.size("embedding")
    power = F.ceil(F.log2(size.cast("double"))).cast("int")
    found = []
    for r in classes.groupBy(power.alias("power")).agg(F.max(size).alias("width")).orderBy("power").collect():  # at most 32 rows
        found.append(_links(classes.where(power == r["power"]), r["width"], kind, cosine, tile, band, sample, axes))
    empty = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    if not found:
        return empty
    links = found[0]
    for f in found[1:]:
        links = links.union(f)
    comps = C.components(links.select("a", "b"))
    sums = links.groupBy(F.col("a").alias("cid")).agg(F.sum("add").alias("more"))
    known = (classes.join(sums, "cid", "left").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
             .select("embedding", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "cid").alias("component_id")))
    out = ok.join(known, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(empty)
