"""BPE encoding and decoding as bounded-memory streaming transducers.

Encoding reads a text in slices and its pre-tokens as symbols.  Every pre-token runs through one
transducer: it holds a window of symbols, merges them by rank, and emits the tokens that end at least the
merge list's sufficient lookahead before the window's end; no symbol still to come can change those.
What follows an emitted token's end is encoded as if it began there, so the window stays bounded however
long the pre-token is.  A bounded memo of short pre-tokens stands behind that.

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine and never holds more than an
unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: How byte-level vocabularies write bytes as printable characters.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    out = {b: chr(b) for b in _PRINTABLE}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(_PRINTABLE))
    return [out[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """How many symbols after a token's end decide that it ends there.

    A token's last piece (itself, the right part of the merge that made it, and so on) may still be taken
    by a merge with what follows, if that has a lower rank than the merge which takes the piece here.  What
    follows must be formed for that, and may itself be taken first, by a merge of a still lower rank.  The
    longest such chain of falling ranks, in symbols, is the bound.  Expects merges of letters or of earlier
    merges' texts; otherwise gives the bound that holds for any list, merges times the longest text.
    """
    made: dict[str, list[int]] = {}
    for rank, (a, b) in enumerate(merges):
        made.setdefault(a + b, []).append(rank)
    if any(made[x][0] > rank for rank, pair in enumerate(merges) for x in pair if x in made):
        return len(merges) * max(len(a) + len(b) for a, b in merges)
    ranks: dict[str, list[int]] = {}  # of the merges with this left part
    most: dict[str, list[int]] = {}  # the farthest chain of those up to each

    def taken(piece: str, limit: int) -> int:
        """The farthest chain that begins by taking the piece at a rank under the limit."""
        at = bisect_left(ranks.get(piece, ()), limit)
        return most[piece][at - 1] if at else 0

    def after(token: str, limit: int) -> int:
        far, pieces = taken(token, limit), [token]
        while pieces:
            for rank in made.get(pieces.pop(), ()):
                right = merges[rank][1]
                far = max(far, taken(right, rank))
                pieces.append(right)
        return far

    for rank, (a, b) in enumerate(merges):
        far = len(b) + after(b, rank)
        ranks.setdefault(a, []).append(rank)
        known = most.setdefault(a, [])
        known.append(max(far, known[-1]) if known else far)
    return max((after(x, len(merges)) for x in {x for a, b in merges for x in (a, b, a + b)}), default=0)


class Transducer:
    """Encoder over symbol strings for one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", step: int = 256) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        self.longest = max((len(a) + len(b) for a, b in merges), default=1)
        self.window = self.lookahead + self.longest + step
        self.runs = 0  # pre-tokens that ran through

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges by rank, the leftmost of equals first."""
        out, get, none = symbols, self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(out, out[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            at = ranks.index(low)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((out[at], out[at + 1]), none)
            if at:
                ranks[at - 1] = get((out[at - 1], out[at]), none)
        return out

    def size(self, token: str) -> int:
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) else len(token)


class Stream:
    """One pre-token on its way through a transducer: letters in, stable tokens out."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine
        self.waiting: list[str] = []  # symbols whose tokens aren't stable

    def feed(self, letters: str) -> list[int]:
        """Ids that are stable now; the pre-token goes on."""
        machine, out, at = self.machine, [], 0
        waiting = self.waiting
        waiting.extend(letters)
        # one symbol is held back, as the last one carries the suffix
        while len(waiting) - at > machine.window:
            end = 0
            for token in machine.merged(waiting[at : at + machine.window]):
                if end + len(token) > machine.window - machine.lookahead:
                    break
                end += len(token)
                out.append(machine.vocab[token])
            at += end
        del waiting[:at]
        return out

    def finish(self) -> list[int]:
        """Ids of what is left; the pre-token ends here."""
        machine, waiting = self.machine, self.waiting
        machine.runs += 1
        if not waiting:
            return []
        waiting[-1] += machine.suffix
        return [machine.vocab[t] for t in machine.merged(waiting)]


#: A slice may end between two of these, which belong to one run of signs.
_SIGNS = frozenset("!#$%&()*+,-./:;=?@[]^_`{}~")


class Codec:
    """A tokenizers-style vocabulary file: normaliser, splitter, transducer, decoder."""

    def __init__(self, path: str, memo: int = 1 << 18, slice_: int = 1 << 16, step: int = 256) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.fold = bool(spec.get("normalizer"))
        self.vocab = model["vocab"]
        self.machine = Transducer(self.vocab, merges, model.get("end_of_word_suffix") or "", step)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = split_pattern(spec)
        self.words = regex.compile(pattern)
        # of ASCII text the classes are plain ranges, which the standard engine finds faster
        plain = pattern.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^ \t\n\r\x0b\x0cA-Za-z0-9]")
        self.ascii = None if "\\" in plain.replace(r"\t\n\r\x0b\x0c", "") else re.compile(plain)
        self.letter = byte_letters()
        self.byte = {x: b for b, x in enumerate(self.letter)}
        self.joiner = b"" if spec.get("decoder") else b" "
        self.token = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for x, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = x
        self.bytes = [x.encode() if self.joiner or i in {*self.special.values()} or any(c not in self.byte for c in x)
                      else bytes(map(self.byte.__getitem__, x)) for i, x in enumerate(self.token)]
        self.memo: dict[str, list[int]] = {}
        self.most, self.slice = memo, slice_

    def _normal(self, text: str) -> str:
        if not self.fold:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return text.lower()

    def _stop(self, text: str, at: int, end: int) -> tuple[int, bool]:
        """Where a slice from `at` can end: before white space or between two letters, digits or signs, where
        neither normalising nor splitting looks across; and whether a pre-token may go on there."""
        size = self.slice
        while at + size < end:
            for p in range(at + size, at + size // 2, -1):
                if text[p].isspace() and not text[p - 1].isspace():
                    return p, False
            for p in range(at + size, at + size // 2, -1):
                a, b = text[p - 1], text[p]
                if "'" in text[p - 3 : p]:  # a contraction may end here
                    continue
                if a.isalnum() and b.isalnum() and not 0x1100 <= ord(b) <= 0x11FF or a in _SIGNS and b in _SIGNS:
                    return p, True
            size *= 2
        return end, False

    def _letters(self, word: str) -> str:
        return "".join(map(self.letter.__getitem__, word.encode("utf-8", "surrogatepass")))

    def _word(self, word: str) -> list[int]:
        stream = Stream(self.machine)
        return stream.feed(self._letters(word)) + stream.finish()

    def _ids(self, words: list[str]) -> Iterable[int]:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        new = set(words).difference(memo)
        for word in new:
            memo[word] = self._word(word)
        out = [*chain.from_iterable(map(memo.__getitem__, words))]
        for word in new:
            if len(word) > 64:  # the memo holds short ones
                del memo[word]
        return out

    def _run(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """Ids of text[at:end], which holds no special string, slice by slice."""
        going, lead = None, ""  # a pre-token that goes on, and its last character
        while at < end:
            stop, open_ = self._stop(text, at, end)
            part = self._normal(text[at:stop])
            words = self.ascii if self.ascii and part.isascii() else self.words
            begin = 0
            if going is not None:
                begin = self.words.match(lead + part).end() - 1
                yield going.feed(self._letters(part[:begin]))
                if begin == len(part) and open_:
                    at, lead = stop, part[-1]
                    continue
                yield going.finish()
                going = None
            found = words.findall(part, begin)
            if open_ and found:
                last = found[-1]
                if part.endswith(last) and self.words.match(last + self._normal(text[stop])).end() > len(last):
                    going, lead = Stream(self.machine), last[-1]
                    found.pop()
            yield self._ids(found)
            if going is not None:
                yield going.feed(self._letters(last))
            at = stop
        if going is not None:
            yield going.finish()

    def encode_pieces(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, piece by piece; memory beside the text is bounded."""
        at = 0
        if self.find_special is not None and "<|" in text:
            for found in self.find_special.finditer(text):
                yield from self._run(text, at, found.start())
                yield [self.special[found.group()]]
                at = found.end()
        yield from self._run(text, at, len(text))

    def decode_pieces(self, pieces: Iterable[list[int]]) -> Iterator[str]:
        """The text of ids that come piece by piece: what the library gives with special tokens kept, by its
        byte decoder if the file names one, else the tokens' own spellings joined by spaces."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table, between, lead = self.bytes.__getitem__, self.joiner, b""
        for ids in pieces:
            if ids:
                yield machine.decode(lead + between.join(map(table, ids)))
                lead = between
        yield machine.decode(b"", True)

    def encode(self, text: str) -> np.ndarray:
        return np.array([*chain.from_iterable(self.encode_pieces(text))], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.decode_pieces(ids[at : at + 4096].tolist() for at in range(0, len(ids), 4096)))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as little-endian unsigned 32-bit integers, and of the text that
        they decode to, fed piece by piece."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def passing() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.encode_pieces(text):
                n += len(ids)
                of_ids.update(np.array(ids, "<u4").tobytes())
                yield ids

        for piece in self.decode_pieces(passing()):
            of_text.update(piece.encode("utf-8", "surrogatepass"))
        return n, of_ids.hexdigest(), of_text.hexdigest()


def split_pattern(spec: dict) -> str:
    """The pattern of pre-tokens that a vocabulary file names, or the usual one of byte-level files."""
    steps = spec.get("pre_tokenizer") or {}
    for step in steps.get("pretokenizers", [steps]):
        found = (step.get("pattern") or {}).get("Regex")
        if found:
            return found
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(documents: DataFrame) -> DataFrame:
    return C.steady(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids binary, decoded string), one per input row, no shuffle; ids are little-endian
    unsigned 32-bit integers (see `unpacked`).

    Null and empty texts give no ids and an empty text; a null id stays null; repeated rows fare alike, and
    an empty table gives no rows.  Other columns, whatever their names, are not read.  Memory: one small
    piece of a batch, a bounded memo of pre-tokens, and the longest text with its ids.
    """

    def run(frames):
        own = codec(path)
        for pdf in C.pieces(frames, 256, 1 << 20):
            ids = [own.encode(t) if isinstance(t, str) else np.empty(0, "<u4") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": [x.tobytes() for x in ids], "decoded": [own.decode(x) for x in ids]})

    return _texts(documents).mapInPandas(run, "doc_id long, ids binary, decoded string")


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per input row, no shuffle: what encode_decode
    gives, as digests that are fed while it streams, so that neither ids nor decoded texts are held whole.
    Nulls, empty texts and tables, repeated rows and other columns fare as there."""

    def run(frames):
        own = codec(path)
        for pdf in C.pieces(frames, 256, 1 << 20):
            rows = [own.digests(t if isinstance(t, str) else "") for t in pdf["text"]]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy())[
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return _texts(documents).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
