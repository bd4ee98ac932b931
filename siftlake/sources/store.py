"""The store of replaced texts: a table by key, with capacity and expiry read lazily."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import key_md5

CAPACITY, TTL_SECONDS = 1000, 300


def entries(contents: DataFrame, seq: str = "seq", at: str = "at") -> DataFrame:
    """(hash, payload, seq, at) for contents(content, seq, at): what puts in this order leave behind.  Putting
    a key again renews payload and time, but not its place in line."""
    x = contents.select(key_md5(F.col("content")).alias("hash"), F.col("content").alias("payload"), F.col(seq).alias("seq"), F.col(at).alias("at"))
    return x.groupBy("hash").agg(F.max_by("payload", "seq").alias("payload"), F.min("seq").alias("seq"), F.max("at").alias("at"))


def first_in_first_out(store: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The last `capacity` keys in line (a report of bounded size)."""
    return store.orderBy(F.col("seq").desc()).limit(capacity)


def alive(store: DataFrame, now: int, ttl: int | None = TTL_SECONDS) -> DataFrame:
    """Entries whose time hasn't run out at `now`; ttl None keeps all."""
    return store if ttl is None else store.where(F.col("at") + ttl > now)


def get(store: DataFrame, keys: DataFrame) -> DataFrame:
    """(hash, payload) of keys(hash); a miss has no row."""
    return keys.select("hash").distinct().join(store, "hash").select("hash", "payload")


@dataclass(frozen=True)
class StoreConfig:
    """kind "fifo" holds the last `capacity` keys; kind "table" has no capacity.  ttl_seconds None never expires."""

    path: str
    kind: str = "table"
    capacity: int = CAPACITY
    ttl_seconds: int | None = TTL_SECONDS


def merged(puts: DataFrame) -> DataFrame:
    """One entry for each hash: the latest payload and time, the first place in line."""
    last = F.max_by(F.struct("payload", "at"), F.struct("at", "seq")).alias("l")
    return puts.groupBy("hash").agg(last, F.min("seq").alias("seq")).select("hash", "l.payload", "seq", "l.at")


class TableStore:
    """A store kept as Parquet tables below a shared path; one writer at a time.

    A put to a store without capacity writes its own entries as one more part and then a list of the parts
    that count; after `compact_after` parts they become one.  A store with a capacity is that small and is
    written anew.  Readers follow the newest complete list, so they and puts run again after a failure see
    whole puts.  Parts that neither of the two newest lists names are removed.
    """

    compact_after = 16

    def __init__(self, spark: SparkSession, config: StoreConfig) -> None:
        self.spark, self.config = spark, config

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.config.path}/{name}" if name else self.config.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._folder(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _lists(self) -> list[str]:
        """Names of the complete lists of parts, the newest last."""
        done = []
        for name in self._names("lists"):
            fs, path = self._folder(f"lists/{name}/_SUCCESS")
            if fs.exists(path):
                done.append(name)
        return done

    def _parts(self, name: str) -> list[str]:
        return [r["part"] for r in self.spark.read.schema("part string").parquet(f"{self.config.path}/lists/{name}").collect()]  # at most compact_after

    def _now(self) -> list[str]:
        known = self._lists()
        return self._parts(known[-1]) if known else []

    def rows(self) -> DataFrame:
        """(hash, payload, seq, at), entries past their time included."""
        parts = self._now()
        if not parts:
            return self.spark.createDataFrame([], "hash string, payload string, seq long, at long")
        table = self.spark.read.parquet(*(f"{self.config.path}/parts/{p}" for p in parts))
        return merged(table) if len(parts) > 1 else table

    def put(self, contents: DataFrame) -> None:
        """contents(content, seq, at), with seq greater than all before."""
        new = entries(contents).select("hash", "payload", F.col("seq").cast("long"), F.col("at").cast("long"))
        part, parts = f"p-{uuid.uuid4().hex}", self._now()
        if self.config.kind == "fifo":
            new, parts = first_in_first_out(merged(self.rows().unionByName(new)), self.config.capacity), []
        elif len(parts) + 1 >= self.compact_after:
            new, parts = merged(self.rows().unionByName(new)), []
        new.write.parquet(f"{self.config.path}/parts/{part}")
        known = self._lists()
        number = int(known[-1]) + 1 if known else 0
        self.spark.createDataFrame([(p,) for p in [*parts, part]], "part string").coalesce(1).write.mode("overwrite").parquet(f"{self.config.path}/lists/{number:020d}")
        self._sweep()

    def _sweep(self) -> None:
        known = self._lists()
        used = {p for name in known[-2:] for p in self._parts(name)}
        for folder, kept in (("lists", set(known[-2:])), ("parts", used)):
            for name in self._names(folder):
                if name not in kept:
                    fs, path = self._folder(f"{folder}/{name}")
                    fs.delete(path, True)

    def get(self, keys: DataFrame, now: int) -> DataFrame:
        return get(alive(self.rows(), now, self.config.ttl_seconds), keys)

    def count(self) -> int:
        """Stored entries; those past their time count until they are put again or fall out of line."""
        return self.rows().count()


def from_config(spark: SparkSession, config: StoreConfig) -> TableStore:
    if config.kind not in ("fifo", "table"):
        raise ValueError(f"unknown store kind {config.kind!r}")
    if config.kind == "fifo" and config.capacity <= 0:
        config = StoreConfig(config.path, config.kind, CAPACITY, config.ttl_seconds)
    return TableStore(spark, config)
