"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the rolling hash of the last 16 bytes is small, so an insertion moves only the chunks
around it.  Chunks are compared by digest over all documents.  A stretch of successive chunks that
earlier places hold too is a repeat when it is long enough; one of several first documents is split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .firsts import repeated

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 16, 256, dtype=np.uint16)
_GEAR[0] = 0
_GAP = 16


def boundaries(data: np.ndarray, mean: int) -> np.ndarray:
    """Whether a chunk may end after each byte: by the gear hash of 16 bits, in four doubling steps, and
    never within a UTF-8 character."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint16(shift)
    end = h < (1 << 16) // mean
    end[:-1] &= (data[1:] & 0xC0) != 0x80
    return end


def chunks(texts: list[bytes], mean: int, most: int):
    """Text number, start, length and digest of every chunk."""
    out = ([], [], [], [])
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= C._BLOCK):
            size += len(texts[to]) + _GAP
            to += 1
        group = texts[at:to]
        data = np.frombuffer(b"".join(t + bytes(_GAP) for t in group), np.uint8)
        offset = np.cumsum([0, *(len(t) + _GAP for t in group)])
        stop = offset[1:] - _GAP
        end = boundaries(data, mean)
        filled = np.array([len(t) > 0 for t in group])
        end[stop[filled] - 1] = True
        cut = np.flatnonzero(end) + 1
        doc = np.searchsorted(offset, cut - 1, side="right") - 1
        inside = cut <= stop[doc]
        cut, doc = cut[inside], doc[inside]
        if len(cut):
            start = np.r_[0, cut[:-1]]
            fresh = np.r_[True, doc[1:] != doc[:-1]]
            start[fresh] = offset[doc[fresh]]
            if (cut - start > most).any():  # forced ends in long stretches without one
                n = -(-(cut - start) // most)
                which = np.repeat(np.arange(len(cut)), n)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                s = start[which] + nth * most
                e = np.minimum(s + most, cut[which])
                cut, start, doc = e, s, doc[which]
            h = np.concatenate([C.span_hashes(data[a:b], start[s] - a, cut[s] - a) for a, b, s in _parts(start, cut)])
            for k, v in enumerate((doc + at, start - offset[doc], cut - start, h)):
                out[k].append(v)
        at = to
    return tuple(np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.int64, np.int64, np.int64, np.uint64), strict=True))


def _parts(start: np.ndarray, end: np.ndarray):
    """Stretches of at most about 1 MB of chunks, so that hashing needs bounded memory."""
    at = 0
    while at < len(start):
        to = int(np.searchsorted(end, start[at] + C._BLOCK, side="right"))
        to = max(to, at + 1)
        yield int(start[at]), int(end[to - 1]), slice(at, to)
        at = to


def _items(mean: int, most: int):
    def items(pdf: pd.DataFrame):
        ids = pdf["doc_id"].to_numpy(np.int64)
        doc, start, size, h = chunks([C.utf8(t) for t in pdf["text"]], mean, most)
        return ids[doc], start << 16 | size, h

    return items


def _spans(least: int):
    def finish(doc: np.ndarray, pos: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        start, size = pos >> 16, pos & 0xFFFF
        end = start + size
        names = ["doc_id", "start_byte", "end_byte", "first_doc_id"]
        if not len(doc):
            return pd.DataFrame({n: [] for n in names})
        head = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != end[:-1])]
        run = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        last = np.r_[heads[1:], len(doc)] - 1
        total = end[last] - start[heads]
        # bytes of each run by first document
        order = np.lexsort((first, run))
        new = np.r_[True, (run[order][1:] != run[order][:-1]) | (first[order][1:] != first[order][:-1])]
        at = np.flatnonzero(new)
        part = np.add.reduceat(size[order], at)
        of = run[order][at]
        best = np.lexsort((part, of))
        final = np.r_[of[best][1:] != of[best][:-1], True]
        most = np.zeros(len(heads), np.int64)
        source = np.zeros(len(heads), np.int64)
        most[of[best][final]] = part[best][final]
        source[of[best][final]] = first[order][at][best][final]
        # a run without a main first document is split where the first document changes
        own = np.where((2 * most >= total)[run], source[run], first)
        heads = np.flatnonzero(head | np.r_[True, own[1:] != own[:-1]])
        last = np.r_[heads[1:], len(doc)] - 1
        ok = (total >= least)[run[heads]]
        return pd.DataFrame({"doc_id": doc[heads][ok], "start_byte": start[heads][ok], "end_byte": end[last][ok], "first_doc_id": own[heads][ok]}, columns=names)

    return finish


def repeated_substrings(documents: DataFrame, mean: int = 24, most: int = 4096, least: int = 96, batch_rows: int = 2000) -> DataFrame:
    """Rows (doc_id, start_byte, end_byte, first_doc_id): stretches of chunks whose digests occur at an
    earlier place (by doc_id, then position), of `least` bytes or more.  A stretch with at least half of its
    bytes first seen in one document is one row; any other is split, whole, into rows at each change of the
    first document, so these may be shorter than `least`.  Offsets are in UTF-8 bytes, never within a character.

    Null and empty texts, rows without an id and empty tables give none.  doc_id names a text: the same row
    twice repeats nothing by that.  Other columns, whatever their names, aren't read.  Memory: one batch, or one fragment of the digest order, per task.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return repeated(docs, _items(mean, most), _spans(least), "doc_id long, start_byte long, end_byte long, first_doc_id long", batch_rows=batch_rows)
