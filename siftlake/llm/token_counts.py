"""Token counts by rank-synchronous merging over ragged arrays.

The new pre-tokens of a batch are laid end to end in one symbol array.  Each round looks up the rank of
every adjacent pair, takes each pre-token's lowest, and applies it wherever it stands in that pre-token,
for all pre-tokens at once.  When no pair has a rank, the symbols left are the tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bpe import byte_letters, split_pattern

_NONE = np.int64(1 << 40)


class Counter:
    def __init__(self, path: str, memo: int = 1 << 19, batch_symbols: int = 1 << 19) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.first = np.array([vocab[x] for x in byte_letters()], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.product = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.words = regex.compile(split_pattern(spec))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, int] = {}
        self.most, self.batch_symbols = memo, batch_symbols

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; _NONE across the ends of pre-tokens."""
        out = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            out[:-1][hit] = self.order[at[hit]]
        return out

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        sizes = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), sizes)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        counts = np.zeros(len(words), np.int64)
        while len(symbols):
            ranks = self._ranks(symbols, owner)
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(ranks, heads)
            runs = np.diff(np.r_[heads, len(symbols)])
            done = least == _NONE
            counts[owner[heads[done]]] = runs[done]
            best = np.repeat(least, runs)
            place = np.flatnonzero((ranks == best) & (best != _NONE))
            # places one apart overlap (a pair of equal symbols): every second of such a run merges
            chain = np.r_[True, np.diff(place) != 1] if len(place) else np.empty(0, bool)
            head = np.flatnonzero(chain)
            nth = np.arange(len(place)) - np.repeat(head, np.diff(np.r_[head, len(place)])) if len(place) else place
            place = place[nth % 2 == 0]
            symbols = symbols.copy()
            symbols[place] = self.product[ranks[place]]
            keep = ~np.repeat(done, runs)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, words: set[str]) -> None:
        group: list[str] = []
        size = 0
        for w in [*words, None]:
            if w is None or size + len(w) > self.batch_symbols:
                if group:
                    counts = self.surviving([g.encode("utf-8", "surrogatepass") for g in group])
                    self.memo.update(zip(group, counts.tolist(), strict=True))
                group, size = [], 0
            if w is not None:
                group.append(w)
                size += len(w)

    def count(self, texts: list[str | None]) -> list[int]:
        split = []
        for text in texts:
            text = text or ""
            parts = self.cut.split(text) if self.cut and "<|" in text else [text]
            found, extra = [], 0
            for part in parts:
                if part in self.special:
                    extra += 1
                elif part:
                    found += self.words.findall(part)
            split.append((found, extra))
        if len(self.memo) > self.most:
            self.memo.clear()
        new: set[str] = set()
        for found, _ in split:
            new.update(found)
        self.learn(new.difference(self.memo))
        get = self.memo.__getitem__
        return [sum(map(get, found)) + extra for found, extra in split]


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per input row, no shuffle.

    Null and empty texts count no bytes and no tokens; a null id stays null; repeated rows fare alike, and an
    empty table gives no rows.  Other columns, whatever their names, are not read.  Memory: one piece of a
    batch, its longest text's words, and a bounded memo.
    """

    def run(frames):
        own = counter(path)
        for pdf in C.pieces(frames, 512, 2 << 20):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            n = own.count(texts)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(C.utf8(t)) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return C.steady(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
