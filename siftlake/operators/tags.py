"""Custom tags kept out of a rewrite's way: placeholders in, originals back."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard HTML element names, in their usual groups.
HTML_TAGS = """html base head link meta style title body address article aside footer h1 h2 h3 h4 h5 h6 header hgroup main nav section search
blockquote dd div dl dt figcaption figure hr li menu ol p pre ul a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr
area audio img map track video embed iframe object param picture portal source svg math canvas noscript script del ins caption col colgroup table tbody td tfoot th thead tr
button datalist fieldset form input label legend meter optgroup option output progress select textarea details dialog summary slot template"""
_KNOWN = frozenset(HTML_TAGS.split())
_NAME = re.compile(r"<(/?)([A-Za-z_][A-Za-z0-9_.:-]*)")
_CLOSE = re.compile(r"[ \t\n\r\f\v]*>")
RESULT = ("text string, blocks array<struct<placeholder:string,original:string>>, seen int, html int, custom int, self_closing int, orphans int, collision boolean")


def prefix_for(text: str, prefix: str = "{{KEPT_TAG_", attempts: int = 16) -> tuple[str, bool]:
    for p in [prefix, *(f"{prefix}{salt}_" for salt in range(attempts))]:
        if p not in text:
            return p, p != prefix
    return f"{prefix}FALLBACK_", True


class _Ends:
    """Where an open tag's > stands, quoted text passed over.  Every quote and > is looked at once for all tags,
    so that a text of unclosed tags or quotes costs time in proportion to its length."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.marks = [m.start() for m in re.finditer("[\"'>]", text)]
        self.known: dict[int, int | None] = {}

    def after(self, at: int) -> int | None:
        k, path = bisect_left(self.marks, at), []
        while True:
            if k == len(self.marks) or k in self.known:
                end = self.known.get(k)
                break
            path.append(k)
            mark = self.marks[k]
            if self.text[mark] == ">":
                end = mark
                break
            closing = self.text.find(self.text[mark], mark + 1)
            k = len(self.marks) if closing < 0 else bisect_left(self.marks, closing + 1)
        self.known.update(dict.fromkeys(path, end))
        return end


def _tags(text: str):
    """(begin, end, name, closing, self-closing) of every tag."""
    ends, at = _Ends(text), 0
    while found := _NAME.search(text, at):
        at = found.end()
        if found[1]:
            close = _CLOSE.match(text, at)
            if close:
                at = close.end()
                yield found.start(), at, found[2].lower(), True, False
            continue
        end = ends.after(at)
        if end is not None:
            alone = end > at and text[end - 1] == "/"
            at = end + 1
            yield found.start(), at, found[2].lower(), False, alone


def protected(text: str | None, markers: bool = False, prefix: str = "{{KEPT_TAG_") -> dict:
    """Custom tags as placeholders: whole blocks, or with markers=True the tags alone.  Self-closing tags are
    always kept; an unclosed tag stays as text in block mode."""
    out = {"text": text, "blocks": [], "seen": 0, "html": 0, "custom": 0, "self_closing": 0, "orphans": 0, "collision": False}
    if not text or "<" not in text:
        return out
    prefix, out["collision"] = prefix_for(text, prefix)
    waiting: list[tuple[str, int]] = []
    depths: dict[str, list[int]] = {}  # where each name stands in waiting
    spans: list[tuple[int, int]] = []
    for begin, end, name, closing, alone in _tags(text):
        out["seen"] += 1
        if name in _KNOWN:
            out["html"] += 1
        elif alone:
            spans.append((begin, end))
            out["self_closing"] += 1
        elif not closing:
            depths.setdefault(name, []).append(len(waiting))
            waiting.append((name, begin))
            if markers:
                spans.append((begin, end))
        elif not depths.get(name):
            out["orphans"] += 1
        else:
            first = waiting[depths[name][-1]][1]
            for other, _ in reversed(waiting[depths[name][-1] :]):
                depths[other].pop()
                waiting.pop()
            if not markers:
                while spans and spans[-1][0] >= first:
                    spans.pop()
                out["custom"] += 1
            spans.append((begin if markers else first, end))
    parts, at = [], 0
    for i, (a, b) in enumerate(spans):
        mark = f"{prefix}{i}}}}}"
        out["blocks"].append({"placeholder": mark, "original": text[a:b]})
        parts += [text[at:a], mark]
        at = b
    out["text"] = "".join([*parts, text[at:]])
    return out


def protect_tags(text: Column, markers: bool = False, prefix: str = "{{KEPT_TAG_") -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        names = ["text", "blocks", "seen", "html", "custom", "self_closing", "orphans", "collision"]
        return pd.DataFrame([protected(t, markers, prefix) for t in texts], columns=names)

    return F.pandas_udf(run, RESULT)(text)


def restore_tags(text: Column, blocks: Column) -> Column:
    """Originals back in order, wherever their placeholders stand."""
    return F.aggregate(blocks, text, lambda t, b: F.replace(t, b["placeholder"], b["original"]))


def missing_tags(text: Column, blocks: Column) -> Column:
    """Placeholders that a rewrite has lost."""
    return F.transform(F.filter(blocks, lambda b: ~F.contains(text, b["placeholder"])), lambda b: b["placeholder"])
