"""Lines, white space and whole words, as Columns.  Lengths: bytes are octet_length, characters char_length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r \x85\p{Z}]"


def split_plain(text: Column) -> Column:
    return F.split(text, "\n", -1)


def split_lines(text: Column, strip_last_cr: bool = False) -> Column:
    """Lines without a trailing empty one; a CR before a line feed goes, at the end of the text only if asked."""
    parts = split_plain(text)
    n = F.size(parts)

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"\r\z", "")

    last = F.element_at(parts, -1)
    tail = F.when(last == "", F.array().cast("array<string>")).otherwise(F.array(bare(last) if strip_last_cr else last))
    return F.concat(F.transform(F.slice(parts, F.lit(1), n - 1), bare), tail)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def fields(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+", -1), lambda x: x != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_word(text: Column, words: list[str], fold: bool = False) -> Column:
    """Whether any of the words stands whole between bytes that aren't [A-Za-z0-9_]."""
    return text.rlike(("(?i)" if fold else "") + rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])")


def sql_has_word(text: str, words: list[str], fold: bool = False) -> str:
    return f"regexp_matches({text}, '{'(?i)' if fold else ''}(^|[^A-Za-z0-9_])({'|'.join(words)})([^A-Za-z0-9_]|$)')"
