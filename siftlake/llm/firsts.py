"""First occurrences of hashed items over all documents.

Every batch of documents merges its items by hash and sends one entry per distinct hash to the
fragment of the hash order that owns it.  A fragment sorts its entries, compares neighbours and answers
the batches whose items occur elsewhere too.  A batch then knows, for each of its items, whether an
earlier one exists.  An item that every document holds costs one entry a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common as C

WIRE = "batch long, frag long, blob binary"


def _send(items: Callable, n_frag: int, batch_rows: int, batch_bytes: int):
    layout = C.Layout(n_frag)

    def run(frames):
        key = C.batch_key()
        for pdf in C.pieces(frames, batch_rows, batch_bytes):
            doc, pos, h = items(pdf)  # doc ids, positions and hashes, in any order
            h = layout.place(h)
            order = np.lexsort((pos, doc, h))
            doc, pos, h = doc[order], pos[order], h[order]
            new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
            times = np.diff(np.r_[np.flatnonzero(new), len(h)])
            many = np.repeat(times > 1, times)
            out = [(key, -1 - (key + (key >> 24)) % n_frag, C.pack(doc[many], pos[many], h[many]))]
            doc, pos, h, times = doc[new], pos[new], h[new], times.astype(np.uint32)
            for f, s in layout.cuts(h):
                back = np.lexsort((pos[s], doc[s]))  # documents together: their ids pack well
                out.append((key, f, C.pack(C.squeeze(h[s][back]), doc[s][back], pos[s][back], np.minimum(times[s][back], 65535).astype(np.uint16))))
            yield pd.DataFrame(out, columns=["batch", "frag", "blob"])
            key += 1

    return run


def _fragment(shared: bool):
    def run(key, pdf):
        if key[0] < 0:
            return pdf
        parts = [C.unpack(b) for b in pdf["blob"]]
        h = np.concatenate([C.unsqueeze(p[0]) for p in parts])
        doc, pos, times = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        batch = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        order = np.lexsort((pos, doc, h))
        h, doc, pos, times, batch = h[order], doc[order], pos[order], times[order], batch[order]
        new = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        first_doc, first_pos = doc[heads][group], pos[heads][group]
        if shared:
            total = np.add.reduceat(times.astype(np.int64), heads)[group]
            told, first_doc = total >= 2, total
        else:
            told = (doc != first_doc) | (pos != first_pos)
        h, doc, pos, first_doc, batch = h[told], doc[told], pos[told], first_doc[told], batch[told]
        order = np.argsort(batch, kind="stable")
        begin = np.searchsorted(batch[order], np.arange(len(parts) + 1))
        out = []
        for i in np.flatnonzero(np.diff(begin)):
            s = order[begin[i] : begin[i + 1]]
            out.append((pdf["batch"].iloc[i], key[0], C.pack(h[s], doc[s], pos[s], first_doc[s])))
        del parts, h, doc, pos, times, batch, group, first_doc, first_pos
        C.release()
        return pd.DataFrame(out, columns=["batch", "frag", "blob"])

    return run


def _gather(n_frag: int, shared: bool, finish: Callable):
    layout = C.Layout(n_frag)

    def run(key, pdf):
        told = [[np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]]
        own = None
        for frag, blob in zip(pdf["frag"], pdf["blob"], strict=True):
            part = C.unpack(blob)
            if frag < 0:
                own = part
            else:
                told.append([part[0] | layout.lead(frag), *(p.astype(np.int64) for p in part[1:])])
        h, doc, pos, first = (np.concatenate([t[i] for t in told]) for i in range(4))
        mdoc, mpos, mh = own[0].astype(np.int64), own[1].astype(np.int64), own[2]
        if len(mh):
            new = np.r_[True, mh[1:] != mh[:-1]]
            order = np.lexsort((mpos, mdoc, mh))
            mdoc, mpos, mh = mdoc[order], mpos[order], mh[order]
            new = np.r_[True, mh[1:] != mh[:-1]]
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            hd, hp, mfirst = mdoc[heads][group], mpos[heads][group], mdoc[heads][group]
            by = np.argsort(h)
            at = np.minimum(np.searchsorted(h[by], mh), max(len(h) - 1, 0))
            else_ = (h[by][at] == mh) if len(h) else np.zeros(len(mh), bool)
            if len(h):
                mfirst = np.where(else_, first[by][at], mfirst)
            single = ~np.isin(h, mh)
            dup = np.ones(len(mh), bool) if shared else else_ | (mdoc != hd) | (mpos != hp)
            doc, pos, first = (np.concatenate([a[single], b[dup]]) for a, b in ((doc, mdoc), (pos, mpos), (first, mfirst)))
        order = np.lexsort((pos, doc))
        return finish(doc[order], pos[order], first[order])

    return run


def repeated(documents: DataFrame, items: Callable, finish: Callable, schema: str, shared: bool = False,
             batch_rows: int = 2000, batch_bytes: int = 4 << 20, n_frag: int = 0) -> DataFrame:
    """finish(doc, pos, first document) of each batch's items that occur earlier (by doc_id, then position),
    or with `shared` finish(doc, pos, occurrences) of all items that occur more than once.  items(frame) gives
    doc ids, positions, hashes.  The same row twice counts as one place where only earlier places matter."""
    n_frag = n_frag or C.fragments(documents.sparkSession, C.text_bytes(documents))
    sent = C.steady(documents).mapInPandas(_send(items, n_frag, batch_rows, batch_bytes), WIRE)
    told = sent.groupBy("frag").applyInPandas(_fragment(shared), WIRE)
    return told.groupBy("batch").applyInPandas(_gather(n_frag, shared, finish), schema)


def runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Heads of the maximal runs of overlapping or touching [start, end), sorted by doc and start, and the runs' ends."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    base = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + base * wide)
    head = np.r_[True, (start + base * wide)[1:] > reach[:-1]]
    heads = np.flatnonzero(head)
    last = np.r_[heads[1:], len(doc)] - 1
    return heads, reach[last] - base[last] * wide
