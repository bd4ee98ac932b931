"""Shared pieces: scratch tables, word hashing, and the exchange that finds values shared between batches.

Hashes are 64 bits of a seeded polynomial over bytes, finished with an avalanche step; two different
words or shingles collide with probability about 2**-64 per compared pair.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import root as scratch_root


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back, ending its lineage."""
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the scratch files of a table from `cut` that nothing will read again."""
    hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/siftlake-" in path:
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until none is a column of df (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def steady(df: DataFrame) -> DataFrame:
    """df, with the session's row batches no larger than long texts allow (in the scan and towards Python).  The
    settings stay, as df is read later; they change no result."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.parquet.columnarReaderBatchSize", 512)):
        if int(conf.get(key)) > most or int(conf.get(key)) <= 0:
            conf.set(key, str(most))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(documents: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def fragments(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """Into how many ranges the hash order is cut: a power of two, twice the shuffle partitions at least, and
    so many that `size` bytes of texts come to about `each` a range."""
    return 1 << (max(8, 2 * shuffle_partitions(spark), -(-size // each)) - 1).bit_length()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    step = base % (1 << 64)
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(step)
        step = step * step % (1 << 64)
        done += k
    return out


_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = max(n, _BLOCK + (1 << 16))
        _POW["up"] = _powers(_BASE, size)
        _POW["down"] = _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of data[start:end] for each span."""
    up, down = _tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def _finish(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span; data is uint8 and at most a few MB."""
    return _finish(_sums(data, start, end), end - start)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _blocks(text: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """Pieces of about 1 MB with their offsets, and whether a word goes on after the piece: they end before
    white space where some comes within another MB."""
    at = 0
    while len(text) - at > _BLOCK:
        stop = at + _BLOCK
        found = _GAP.search(text, stop, stop + _BLOCK)
        stop = found.start() if found else min(stop + _BLOCK, len(text))
        yield at, text[at:stop], found is None and stop < len(text)
        at = stop
    yield at, text[at:], False


_GAP = re.compile(rb"[ \t-\r]")


def _word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data].view(np.int8)
    edge = np.diff(space, prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def words(texts: list[bytes], lower: bool = True, spans: bool = False):
    """Word hashes of all texts in order, and how many each has; with spans, also byte offsets in each text.

    A word is a run of bytes other than space and 0x09-0x0D; A-Z fold to a-z if lower.  A word of any
    length is hashed piece by piece, so memory beside the texts and results stays bounded.
    """
    hashes, starts, ends = [], [], []
    counts = np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owner: list[tuple[int, int]] = []
    size = 0

    def bytes_of(piece: bytes) -> np.ndarray:
        data = np.frombuffer(piece, np.uint8)
        return _LOWER[data] if lower else data

    def flush() -> None:
        nonlocal size
        if not group:
            return
        data = bytes_of(b" ".join(group))
        s, e = _word_spans(data)
        hashes.append(span_hashes(data, s, e))
        offsets = np.cumsum([0] + [len(x) + 1 for x in group])
        which = np.searchsorted(offsets, s, side="right") - 1
        docs = np.array([o[0] for o in owner])
        np.add.at(counts, docs, np.bincount(which, minlength=len(group)))
        if spans:
            shift = np.array([o[1] for o in owner]) - offsets[:-1]
            starts.append(s + shift[which])
            ends.append(e + shift[which])
        group.clear()
        owner.clear()
        size = 0

    def add_pieces(i: int, at: int, piece: bytes, going, more: bool):
        """The words of one piece, whose first may go on from `going` (sum, start) and whose last may go on."""
        data = bytes_of(piece)
        s, e = _word_spans(data)
        sums, s, e = _sums(data, s, e), s + at, e + at
        if going is not None:
            held, begin = going
            if len(s) and s[0] == at:
                sums[0] = (held + pow(_BASE, at - begin, 1 << 64) * int(sums[0])) % (1 << 64)
                s[0] = begin
            else:
                sums, s, e = np.r_[np.uint64(held), sums], np.r_[begin, s], np.r_[at, e]
        going = (int(sums[-1]), int(s[-1])) if more and len(s) and e[-1] == at + len(piece) else None
        if going is not None:
            sums, s, e = sums[:-1], s[:-1], e[:-1]
        hashes.append(_finish(sums, e - s))
        counts[i] += len(s)
        if spans:
            starts.append(s)
            ends.append(e)
        return going

    for i, text in enumerate(texts):
        going = None
        for at, piece, more in _blocks(text):
            if more or going is not None:
                flush()
                going = add_pieces(i, at, piece, going, more)
                continue
            if size + len(piece) > _BLOCK:
                flush()
            group.append(piece)
            owner.append((i, at))
            size += len(piece) + 1
    flush()
    joined = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    if not spans:
        return joined, counts
    none = np.empty(0, np.int64)
    return joined, counts, np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n successive word hashes (order matters); runs over the ends of texts included."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.empty(len(hashes) - n + 1, np.uint64)
    for at in range(0, len(out), _BLOCK):  # in blocks, for the tables' sake
        part = hashes[at : at + _BLOCK + n - 1]
        up, down = _tables(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(mix(part + np.uint64(0x9E3779B97F4A7C15)) * up[: len(part)], out=total[1:])
        k = len(part) - n + 1
        out[at : at + k] = mix((total[n:] - total[:k]) * down[:k] + np.uint64(n * 0xA24BAED4963EE407 % (1 << 64)))
    return out


def span_grams(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of hashes[start:end] for each span, which has at most a few hundred items; spans come by start."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _BLOCK)))
        low, high = int(start[at]), int(end[at:to].max())
        part = hashes[low:high]
        up, down = _tables(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(mix(part + np.uint64(0x9E3779B97F4A7C15)) * up[: len(part)], out=total[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        at = to
    return out


# ---------------------------------------------------------------- blobs

def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    kinds = "".join(a.dtype.str.ljust(4) for a in arrays).encode()
    return b"".join([head, kinds, *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at = 8 + 8 * n
    kinds = blob[at : at + 4 * n].decode()
    at += 4 * n
    out = []
    for i, size in enumerate(sizes):
        kind = np.dtype(kinds[4 * i : 4 * i + 4].strip())
        out.append(np.frombuffer(blob, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def squeeze(h: np.ndarray) -> np.ndarray:
    """The low 48 bits, six bytes each (what a fragment holds shares its top bits)."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def unsqueeze(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def squeeze_sorted(h: np.ndarray) -> np.ndarray:
    """The low 48 bits of values sorted by these: the first, then differences of five bytes, or of six where one is large."""
    low = h.astype("<u8") & np.uint64((1 << 48) - 1)
    step = np.diff(low)
    width = 5 if not len(step) or int(step.max()) < 1 << 40 else 6
    body = step.view(np.uint8).reshape(-1, 8)[:, :width].reshape(-1)
    return np.concatenate([np.full(min(1, len(low)), width, np.uint8), low[:1].view(np.uint8), body])


def unsqueeze_sorted(b: np.ndarray) -> np.ndarray:
    if not len(b):
        return np.empty(0, np.uint64)
    width = int(b[0])
    out = np.zeros((1 + (len(b) - 9) // width, 8), np.uint8)
    out[0] = b[1:9]
    out[1:, :width] = b[9:].reshape(-1, width)
    return np.cumsum(out.reshape(-1).view("<u8").astype(np.uint64), dtype=np.uint64)


class Layout:
    """Hashes in n ranges (fragments) of their order, n a power of two.  A placed hash holds its fragment
    above its low 48 bits; from 65,536 fragments on it is the hash itself."""

    def __init__(self, n: int) -> None:
        self.bits = n.bit_length() - 1
        self.down = max(0, self.bits - 16)  # of a fragment's number, what lies below bit 48

    def place(self, h: np.ndarray) -> np.ndarray:
        top = h >> np.uint64(64 - min(self.bits, 16))
        return (h & np.uint64((1 << 48) - 1)) | (top << np.uint64(48))

    def cuts(self, placed: np.ndarray) -> list[tuple[int, slice]]:
        """The fragments of sorted placed hashes, and where each lies."""
        frag = placed >> np.uint64(48 - self.down)
        begin = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]]) if len(frag) else np.empty(0, np.int64)
        return [(int(frag[a]), slice(int(a), int(z))) for a, z in zip(begin, np.r_[begin[1:], len(frag)])]

    def lead(self, frag: int) -> np.uint64:
        """What the placed hashes of a fragment hold above their low 48 bits."""
        return np.uint64(frag >> self.down << 48)


def batch_key() -> int:
    """The first of the ids that this task may give to its batches; the same when the task is run again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 24


def pieces(frames, max_rows: int, max_bytes: int, column: str = "text"):
    """The same rows in frames of at most so many rows and characters (one long text may be more)."""
    waiting, rows, total = [], 0, 0
    for pdf in frames:
        sizes = pdf[column].map(lambda x: len(x) if isinstance(x, str) else 0).to_numpy()
        at = 0
        for i, size in enumerate(sizes):
            if rows and (rows >= max_rows or total + size > max_bytes):
                if i > at:
                    waiting.append(pdf.iloc[at:i])
                yield waiting[0] if len(waiting) == 1 else pd.concat(waiting, ignore_index=True)
                waiting, rows, total, at = [], 0, 0, i
            rows += 1
            total += int(size)
        if at < len(pdf):
            waiting.append(pdf.iloc[at:])
    if waiting:
        yield waiting[0] if len(waiting) == 1 else pd.concat(waiting, ignore_index=True)
    del waiting
    release()


def release() -> None:
    """Hand freed memory back, so that a worker that waits for its next task holds little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


# ---------------------------------------------------------------- components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (id, component_id), the smallest id reachable.

    Labels take the least of their neighbours' labels, then jump to their label's label; joins and
    pre-aggregated minima only.  Only ids that have an edge are returned.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                 .select("id", F.least("id", "m").alias("component_id")))
    for _ in range(max_rounds):
        told = (both.join(labels.withColumnRenamed("id", "b"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("m")))
        met = labels.join(told, "id").select("id", F.col("component_id").alias("was"),
                                             F.least("component_id", "m").alias("c"))
        onward = labels.select(F.col("id").alias("c"), F.col("component_id").alias("c2"))
        new = cut(met.join(onward, "c", "left").select("id", "was", F.least("c", F.coalesce("c2", "c")).alias("component_id")))
        moved = new.where("component_id <> was").limit(1).count()
        drop(labels)
        labels = new.select("id", "component_id")
        if not moved:
            drop(both)
            return labels
    raise RuntimeError("components did not settle")


def hash_unit(column: Column, seed: str) -> Column:
    """A repeatable number in [0, 1) from an id."""
    digest = F.md5(F.concat_ws("|", column.cast("string"), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
