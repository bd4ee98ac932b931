"""Shards by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked; a group of them that fits a shard stays whole.  All start on a
shard of their own id's hash.  A group moves to the shard where most of its documents stand, as far as
that shard's quota goes.  Groups that are large beside a quota are few; they are let in one by one, the
largest first, each to another shard with room where its own has none.  The others ask in rounds: demand
is summed per target and hash bucket, and the buckets that fit are let in.  Groups above a shard's rows
are split into parts that fill one.  Documents without links, and groups that no shard could take whole,
fill what is left in the order of their ranks; ranks come from bounded buckets with summed offsets, never
from a window over a whole group or table.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_KEY = ["g", "size", "text_crc32"]


def _ranked(df: DataFrame, within: list[str], buckets: list[str]) -> DataFrame:
    """df with p, the rank among rows of equal `within` by `buckets`, then group and id; the buckets' counts are few."""
    counts = df.groupBy(*within, *buckets).agg(F.count("*").alias("n_bucket"))
    before = Window.partitionBy(*within).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, *buckets, F.coalesce(F.sum("n_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*within, *buckets).orderBy(*dict.fromkeys([*_KEY, "doc_id"]))
    return df.withColumn("p", F.row_number().over(inside) - 1).join(F.broadcast(offsets), [*within, *buckets]).withColumn(
        "p", F.col("p") + F.col("offset")).drop("offset")


def _place_large(nodes: list, room: list[int]) -> list[dict]:
    """Where each large node goes: its own label if it has room, else the tightest shard that has, else nowhere
    (then ord numbers it).  Takes from room."""
    out, left = [], itertools.count()
    for r in sorted(nodes, key=lambda r: (-r["n"], r["g"], r["size"], r["text_crc32"], r["part"])):
        to = r["label"]
        if room[to] < r["n"]:
            to = min((s for s in range(len(room)) if room[s] >= r["n"]), key=lambda s: room[s], default=None)
        if to is not None:
            room[to] -= r["n"]
        out.append({**{k: r[k] for k in (*_KEY, "part")}, "shard": to, "ord": next(left) if to is None else None})
    return out


def balanced_shards(documents: DataFrame, n_shards: int = 40, rounds: int = 6, quota_buckets: int = 256) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, label), one per input row.

    The law is `rows`: the shards' row counts are at most one apart; slot numbers a shard's rows from 0
    without gaps.  size: UTF-8 bytes plus 16.  A null text counts no bytes, has checksum 0 and is linked
    with other nulls.  label is the shard that propagation chose; for documents that only fill room, the
    one they started on.  Equal rows may swap slots; a null id stays null.  An empty table gives no rows.
    Other columns, whatever their names, aren't read.

    Groups of more rows than a shard are split into full parts and a rest.  Other groups are cut only where
    the room left in the shards is too scattered for them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = C.cut(C.steady(documents).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(F.col("text").isNull(), text).alias("g"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("start")), F.lit(n_shards)).cast("int").alias("label")))
    total = slim.count()
    base = total // n_shards
    quota = [base + (s < total % n_shards) for s in range(n_shards)]
    room = [*quota]
    rows = max(512, total // 200_000)  # of a bucket of ranks
    sizes = C.cut(slim.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1"))
    few = sizes.where(F.col("n") > base // quota_buckets)  # at most about n_shards * quota_buckets rows
    rest = slim.join(F.broadcast(few.select(*_KEY)), _KEY, "left_anti")
    tie = F.xxhash64("label", "g").alias("tie")

    # large groups
    members = C.cut(slim.join(F.broadcast(few), _KEY).withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit("sub")), F.ceil(F.col("n") / rows)).cast("int")))
    fits = F.col("n") <= max(quota)
    columns = ["doc_id", *_KEY, "label", "sub"]
    parts = _ranked(members.where(~fits), _KEY, ["sub"]).select(*columns, F.floor(F.col("p") / max(base, 1)).cast("int").alias("part"))
    members = C.cut(members.where(fits).select(*columns, F.lit(0).alias("part")).union(parts))
    node = [*_KEY, "part"]
    nodes = (members.groupBy(*node, "label").agg(F.count("*").alias("n")).groupBy(*node)
             .agg(F.max(F.struct("n", tie, "label")).alias("b"), F.sum("n").alias("n")).select(*node, "n", "b.label").collect())
    placed = _place_large(nodes, room)
    schema = "array<struct<g: bigint, size: bigint, text_crc32: bigint, part: int, shard: int, ord: int>>"
    spark = documents.sparkSession
    places = C.cut(spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(placed)), schema)).alias("x")).select("x.*"))
    n_left = sum(x["shard"] is None for x in placed)
    large = members.join(F.broadcast(places), node).select("doc_id", *_KEY, "label", "shard", "ord", "sub")

    # small groups, in rounds
    many = sizes.where(F.col("n") <= base // quota_buckets)
    buckets = max(1, total // rows)
    single = rest.join(many.select(*_KEY), _KEY, "left_anti").select(
        "doc_id", *_KEY, "label", F.lit(None).cast("int").alias("shard"),
        (F.pmod(F.xxhash64("doc_id", F.lit("fill")), F.lit(buckets)) + n_left + buckets).cast("int").alias("ord"), F.lit(0).alias("sub"))
    docs = large.union(single)
    if base // quota_buckets > 1:
        linked = C.cut(rest.join(many, _KEY).select("doc_id", *_KEY, "label"))
        pending = C.cut(linked.groupBy(*_KEY, "label").agg(F.count("*").alias("c")).groupBy(*_KEY).agg(
            F.sum("c").alias("n"), F.collect_list(F.struct("c", tie, "label")).alias("places")))
        settled = []
        for turn in range(rounds):
            own = 2 * turn < rounds  # later rounds ask by hash where there is most room
            free = [s for s in range(n_shards) if room[s] > 0 and (own or 2 * room[s] >= max(room))]
            if not free:
                break
            shards = F.array(*(F.lit(s) for s in free))
            to = F.get(shards, F.pmod(F.xxhash64(*_KEY, F.lit(turn)), F.lit(len(free))).cast("int"))
            if own:
                to = F.coalesce(F.array_max(F.filter("places", lambda p: F.array_contains(shards, p["label"])))["label"], to)  # noqa: B023
            asking = pending.withColumn("to", to).withColumn("bucket", F.pmod(F.xxhash64(*_KEY, F.lit("bucket"), F.lit(turn)), F.lit(quota_buckets)).cast("int"))
            asked = asking.groupBy("to", "bucket").agg(F.sum("n").alias("n")).collect()  # at most n_shards * quota_buckets rows
            if not asked:
                break
            let_in = [["0"] * quota_buckets for _ in range(n_shards)]
            for r in sorted(asked, key=lambda r: (r["to"], r["bucket"])):
                if r["n"] <= room[r["to"]]:
                    room[r["to"]] -= r["n"]
                    let_in[r["to"]][r["bucket"]] = "1"
            masks = F.array(*(F.lit("".join(x)) for x in let_in))
            state = C.cut(asking.select(*_KEY, "n", "places", F.when(F.substring(F.get(masks, F.col("to")), F.col("bucket") + 1, F.lit(1)) == "1", F.col("to")).alias("shard")))
            settled.append(state.where("shard is not null").select(*_KEY, "shard"))
            pending = state.where("shard is null").drop("shard")
        settled.append(pending.select(*_KEY, F.lit(None).cast("int").alias("shard")))
        small = linked.join(C.cut(_union(settled)), _KEY).select(
            "doc_id", *_KEY, "label", "shard", (F.pmod(F.xxhash64(*_KEY, F.lit("fill")), F.lit(buckets)) + n_left).cast("int").alias("ord"), F.lit(0).alias("sub"))
        docs = docs.union(small)

    # slots: settled documents first, in each shard; the others fill the room left, shard by shard
    here = F.col("shard").isNotNull()
    spread = F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(-(-max(base, 1) // rows))).cast("int")
    ranked = C.cut(docs.select("doc_id", *_KEY, F.coalesce("shard", "label").alias("label"), F.coalesce("shard", F.lit(-1)).alias("at"),
                               F.when(here, 0).otherwise(F.col("ord")).alias("ord"), F.when(here, spread).otherwise(F.col("sub")).alias("sub")))
    ends = [*itertools.accumulate(room)]
    fill = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= F.col("p")))
    begin = F.array(*(F.lit(q - e).cast("long") for q, e in zip(quota, ends, strict=True)))  # a shard's taken slots less the room before it
    return _ranked(ranked, ["at"], ["ord", "sub"]).withColumn("shard", F.when(F.col("at") >= 0, F.col("at")).otherwise(fill).cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.when(F.col("at") >= 0, F.col("p")).otherwise(F.col("p") + F.get(begin, F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "label")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out
