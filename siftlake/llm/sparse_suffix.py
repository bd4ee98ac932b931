"""Duplicate passages by sparse suffix arrays over words.

Of all word suffixes only those at minimiser positions are retained: a window of k + w - 1 words keeps the
suffix at the least hash of its w k-word grams (the first of equals), so equal windows keep equal suffixes.
Suffixes whose first k words occur nowhere else can't match and are left out.

The others are dealt to ranges of the order of their first k words.  A range sorts them by content, word by
word, and measures how many words each shares with the next one; the same is done with the words before
them, read backwards.  In either order, suffixes that share at least so many words stand together, so a
match is extended to the left and to the right by one word at a time: windows are equal where the suffixes
share what the window holds on both sides.  The first place of each decides which ones are repeats.

A first gram that occurs very often would make a range too large for one task.  Around such places the
hashes of the windows themselves are dealt to ranges, merged within batches first, which gives the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .firsts import repeated

_WORD = 5  # bytes of a word's hash that travel


def _kept(texts: list[bytes], k: int, w: int):
    """Word hashes, words of each text, k-gram hashes, and for every retained suffix its text, its position,
    and the first and last window (as word positions over all texts) that keep it."""
    h, counts = C.words(texts, lower=False)
    starts = np.cumsum(counts) - counts
    span = k + w - 1
    none = np.empty(0, np.int64)
    g = C.grams(h, k)
    if len(h) < span:
        return h, counts, g, none, none, none, none
    doc = np.repeat(np.arange(len(texts)), counts)
    view = np.lib.stride_tricks.sliding_window_view(g, w)
    at = np.flatnonzero(doc[: len(view)] == doc[span - 1 : span - 1 + len(view)])
    pick = np.concatenate([view[at[i : i + (1 << 16)]].argmin(axis=1) + at[i : i + (1 << 16)] for i in range(0, len(at), 1 << 16)] or [none])
    begin = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]]) if len(pick) else none
    last = np.r_[begin[1:], len(pick)] - 1 if len(pick) else none
    return h, counts, g, doc[pick[begin]] if len(pick) else none, pick[begin] if len(pick) else none, at[begin], at[last]


def _anchors(k: int, w: int):
    def items(pdf: pd.DataFrame):
        ids = pdf["doc_id"].to_numpy(np.int64)
        _, counts, g, doc, pos, _, _ = _kept([C.utf8(t) for t in pdf["text"]], k, w)
        starts = np.cumsum(counts) - counts
        return ids[doc], (pos - starts[doc]).astype(np.uint32), g[pos] if len(pos) else np.empty(0, np.uint64)

    return items


def _positions(often: int):
    """Each document's retained suffixes that occur elsewhere, and of these the ones in more than `often` places."""

    def finish(doc: np.ndarray, pos: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        if not len(doc):
            return pd.DataFrame({"doc_id": np.empty(0, np.int64), "heads": np.empty(0, object), "hot": np.empty(0, object)})
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows = []
        for p, n in zip(np.split(pos, cut[1:]), np.split(total, cut[1:]), strict=True):
            p, at = np.unique(p, return_index=True)
            rows.append((p[n[at] <= often].astype(np.int32), p[n[at] > often].astype(np.int32)))
        return pd.DataFrame({"doc_id": doc[cut], "heads": [r[0] for r in rows], "hot": [r[1] for r in rows]})

    return finish


def _wanted(heads, doc: np.ndarray, pos: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which retained suffixes are among the heads of their texts."""
    known = np.concatenate([np.asarray(x, np.int64) + starts[i] for i, x in enumerate(heads)] or [np.empty(0, np.int64)])
    return np.isin(pos, known)


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), then those of the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _short(h: np.ndarray) -> np.ndarray:
    """The words' hashes in the bytes that travel; never 0."""
    low = np.maximum(h >> np.uint64(64 - 8 * _WORD), np.uint64(1)).astype("<u8")
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :_WORD]).reshape(-1)


def _long(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // _WORD, 8), np.uint8)
    out[:, :_WORD] = b.reshape(-1, _WORD)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _send(k: int, w: int, n_frag: int, batch_rows: int, batch_bytes: int):
    """Suffixes to the ranges of their first k words, with the words around these that windows need; equal
    ones of a batch travel once, with their places."""
    layout, span = C.Layout(n_frag), k + w - 1

    def run(frames):
        for pdf in C.pieces(frames, batch_rows, batch_bytes):
            ids = pdf["doc_id"].to_numpy(np.int64)
            h, counts, g, doc, pos, first, last = _kept([C.utf8(t) for t in pdf["text"]], k, w)
            starts = np.cumsum(counts) - counts
            live = _wanted(pdf["heads"], doc, pos, starts)
            doc, pos, first, last = doc[live], pos[live], first[live], last[live]
            if not len(pos):
                continue
            left, right = pos - first, last + span - pos - k
            key = layout.place(g[pos])
            whole = C.span_grams(h, first, last + span)
            order = np.lexsort((pos, ids[doc], left, right, whole, key))
            doc, pos, left, right, key, whole = (x[order] for x in (doc, pos, left, right, key, whole))
            new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
            of = np.cumsum(new) - 1
            rows = []
            for frag, s in layout.cuts(key):
                at = np.arange(s.start, s.stop)[new[s]]
                words = np.concatenate([h[_ragged(pos[at] - left[at], left[at])], h[_ragged(pos[at] + k, right[at])]])
                rows.append((frag, C.pack(C.squeeze(key[at]), left[at].astype(np.uint8), right[at].astype(np.uint8), _short(words),
                                          (of[s] - of[s.start]).astype(np.uint32), ids[doc[s]], (pos[s] - starts[doc[s]]).astype(np.uint32))))
            yield pd.DataFrame(rows, columns=["frag", "blob"])

    return run


def _matrix(words: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(size), width), np.uint64)
    out[np.repeat(np.arange(len(size)), size), _ragged(np.zeros(len(size), np.int64), size)] = words
    return out


def _shared(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key, then word by word, and how many leading words each row in that order shares
    with the one before (-1 where the key differs)."""
    order = np.lexsort((*words.T[::-1], key))
    same = words[order][1:] == words[order][:-1]
    common = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1)) if words.shape[1] else np.zeros(len(same), np.int64)
    common = np.where(key[order][1:] == key[order][:-1], common, -1)
    return order, np.r_[-1, common] if len(order) else common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for rows that share at least `depth` leading words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def extended(key: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray):
    """For suffixes with the words before them (nearest first) and after their first k: the suffix that holds
    each window first, by place, as first[row, words of the window before the suffix]; -1 where it has none.
    A row's windows hold from width - right to left words before it."""
    n, width = before.shape
    backward, forward = _shared(key, before), _shared(key, after)
    first = np.full((n, width + 1), -1, np.int64)
    by_place = np.argsort(place, kind="stable")
    for j in range(width + 1):
        at = by_place[(left[by_place] >= j) & (width - right[by_place] <= j)]
        if len(at):
            both = _classes(*backward, j)[at] * (n + 1) + _classes(*forward, width - j)[at]
            order = np.argsort(both, kind="stable")  # the first of each class has the least place
            new = np.r_[True, both[order][1:] != both[order][:-1]]
            first[at[order], j] = at[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return first


def _range(k: int, w: int):
    """The repeated stretches around the suffixes of one range."""
    width, span = w - 1, k + w - 1

    def run(key, pdf):
        parts = [C.unpack(b) for b in pdf["blob"]]
        sizes = [len(p[1]) for p in parts]
        keys = np.concatenate([C.unsqueeze(p[0]) for p in parts])
        left, right = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2))
        words = [_long(p[3]) for p in parts]
        nl = [int(p[1].astype(np.int64).sum()) for p in parts]
        before = _matrix(np.concatenate([x[:m] for x, m in zip(words, nl, strict=True)]), left, width)
        # words before the suffix came first to last; nearest first is wanted
        flip = left[:, None] - 1 - np.arange(width)[None, :]
        before = np.where(flip >= 0, np.take_along_axis(before, np.maximum(flip, 0), 1), np.uint64(0))
        after = _matrix(np.concatenate([x[m:] for x, m in zip(words, nl, strict=True)]), right, width)
        row = np.concatenate([p[4].astype(np.int64) + at for p, at in zip(parts, np.cumsum([0, *sizes[:-1]]), strict=True)])
        doc, pos = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (5, 6))
        # places are numbered by document and position; a row's place is its least
        order = np.lexsort((pos, doc))
        new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (pos[order][1:] != pos[order][:-1])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        doc_of = doc[order][new]
        least = np.full(len(left), len(order), np.int64)
        np.minimum.at(least, row, place)
        first = extended(keys, before, after, left, right, least)
        # of a row's least place the windows that another place holds first; of its other places all
        known = np.where(first >= 0, least[first], -1)
        again = (known >= 0) & (known != least[:, None])
        any_ = again.any(axis=1)
        far = width - again[:, ::-1].argmax(axis=1)  # most words before: the leftmost window
        near = again.argmax(axis=1)
        own = place == least[row]
        use = ~own | any_[row]
        row, own, doc, pos = row[use], own[use], doc[use], pos[use]
        j = np.where(own, far[row], left[row])
        to = np.where(own, near[row], width - right[row])
        out = pd.DataFrame({"doc_id": doc, "start_word": pos - j, "end_word": pos - to + span, "first_doc_id": doc_of[known[row, j]]})
        del parts, words, before, after, flip, first, known, again
        C.release()
        return out

    return run


def _windows(k: int, w: int):
    """Hashes of the windows around hot suffixes."""
    span = k + w - 1

    def items(pdf: pd.DataFrame):
        ids = pdf["doc_id"].to_numpy(np.int64)
        h, counts, _, doc, pos, first, last = _kept([C.utf8(t) for t in pdf["text"]], k, w)
        starts = np.cumsum(counts) - counts
        live = _wanted(pdf["hot"], doc, pos, starts)
        doc, first, last = doc[live], first[live], last[live]
        at = _ragged(first, last - first + 1)
        of = np.repeat(doc, last - first + 1)
        return ids[of], (at - starts[of]).astype(np.uint32), C.grams(h, span)[at] if len(at) else np.empty(0, np.uint64)

    return items


def _found(span: int):
    def finish(doc: np.ndarray, pos: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": doc, "start_word": pos, "end_word": pos + span, "first_doc_id": first})

    return finish


SPANS = "doc_id long, start_word long, end_word long, first_doc_id long"


def joined(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of each document as one, with the first document of its first span."""
    by = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start_word") <= F.col("reach"), 0).otherwise(1)).over(by)
    return (spans.withColumn("reach", reach).withColumn("run", run).groupBy("doc_id", "run")
            .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min_by("first_doc_id", "start_word").alias("first_doc_id"))
            .select("doc_id", "start_word", "end_word", "first_doc_id"))


def repeated_passages(documents: DataFrame, k: int = 16, w: int = 30, batch_rows: int = 2000, batch_bytes: int = 4 << 20,
                      often: int = 50_000, fragments: int = 0) -> DataFrame:
    """Rows (doc_id, start_word, end_word, first_doc_id): maximal word spans [start, end) made of windows of
    k + w - 1 words that an earlier place (by doc_id, then position) holds too; first_doc_id has the first of
    the span's windows.

    Words are runs of bytes other than space and 0x09-0x0D, compared by their bytes' hashes (48 bits and the
    range's number for the first k words, 40 bits for each word beyond).  Null, empty and short texts, rows without an id and empty tables
    give none.  doc_id names a text: the same row twice repeats nothing by that.  Other columns, whatever
    their names, aren't read.  Suffixes whose first k words occur more than `often` times are settled by
    window hashes instead of in one range; the rows are the same.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    n_frag = fragments or C.fragments(spark, C.text_bytes(docs))
    heads = C.cut(repeated(docs, _anchors(k, w), _positions(often), "doc_id long, heads array<int>, hot array<int>", shared=True,
                           batch_rows=batch_rows, batch_bytes=batch_bytes, n_frag=n_frag))
    heads = heads.dropDuplicates(["doc_id"])
    some = C.steady(docs).hint("merge").join(heads.where("size(heads) > 0").drop("hot"), "doc_id").select("doc_id", "text", "heads")
    sent = some.mapInPandas(_send(k, w, n_frag, batch_rows, batch_bytes), "frag long, blob binary")
    spans = sent.groupBy("frag").applyInPandas(_range(k, w), SPANS)
    hot = heads.where("size(hot) > 0").drop("heads")
    if hot.limit(1).count():
        rest = docs.hint("merge").join(hot, "doc_id").select("doc_id", "text", "hot")
        spans = spans.union(repeated(rest, _windows(k, w), _found(k + w - 1), SPANS, batch_rows=batch_rows, batch_bytes=batch_bytes, n_frag=n_frag))
    return joined(spans)


def without_repeats(docs: DataFrame, min_words: int = 5, **params) -> DataFrame:
    """docs with repeated passages cut out of their texts (the first place keeps its own).

    Documents left with fewer than min_words words by that go; untouched ones stay as they are, also those
    without an id.  n_chars follows the text where that column exists.  Columns unchanged, whatever their names.
    """
    key, name = C.fresh(docs, "id", "spans")
    spans = C.cut(repeated_passages(docs, **params)).groupBy(F.col("doc_id").alias(key)).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias(name))  # the spans of one text

    def cut_text(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is None or text is None:
                out.append(text)
                continue
            raw = C.utf8(text)
            _, counts, start, end = C.words([raw], lower=False, spans=True)
            kept, at, left = [], 0, counts[0]
            for s in sorted(found, key=lambda s: s["start_word"]):
                a, b = int(s["start_word"]), int(s["end_word"])
                kept.append(raw[at : start[a]])
                at = int(end[b - 1])
                left -= b - a
            kept.append(raw[at:])
            out.append(b"".join(kept).decode("utf-8", "replace") if left >= min_words else None)
        return pd.Series(out, dtype=object)

    shorten = F.pandas_udf(cut_text, "string")
    hit = docs.hint("merge").join(spans, docs["doc_id"].cast("long") == F.col(key), "left")
    touched = F.col(name).isNotNull()
    out = hit.withColumn("text", shorten("text", name)).where(~touched | F.col("text").isNotNull())
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(touched, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
