"""Token counts by model: exact where the model's vocabulary file is at hand, else the estimate."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import token_estimate

#: How the public encodings split texts before merging.
PATTERNS = {
    "cl100k_base": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s""",
    "o200k_base": r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"""
                  r"""|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"""
                  r"""|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+""",
}
FAMILIES = {"gpt-4o": "o200k_base", "o1": "o200k_base", "o3": "o200k_base", "gpt-4": "cl100k_base", "gpt-3.5": "cl100k_base"}


def encoding_of(model: str) -> str | None:
    """The encoding of a model's family, the first prefix in order; None: estimate."""
    return next((e for prefix, e in FAMILIES.items() if model.lower().startswith(prefix)), None)


@lru_cache(4)
def _encoding(path: str, name: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERNS[name], mergeable_ranks=ranks, special_tokens={})


#: A tokenizer: the number of tokens of a text column, as long; null stays null.
Tokenizer = Callable[[Column], Column]


def estimator(per_token: float = 4.0) -> Tokenizer:
    """Characters over per_token."""
    return lambda text: token_estimate(text, per_token)


def tokenizer_for(model: str = "", folder: str | None = None, others: dict[str, Tokenizer] | None = None) -> Tokenizer:
    """The tokenizer of a model: one of `others` by name, else its vocabulary file's, else the estimate."""
    if others and model in others:
        return others[model]
    return lambda text: count_tokens(text, model, folder)


def count_tokens(text: Column, model: str = "", folder: str | None = None) -> Column:
    """Tokens of text as long; null stays null.  `folder` holds `<encoding>.tiktoken` files and must be readable
    on every executor; without the model's file the count is the estimate, in the JVM alone."""
    name = encoding_of(model)
    path = os.path.join(folder, f"{name}.tiktoken") if folder and name else None
    if path is None or not os.path.exists(path):
        return token_estimate(text)

    def run(texts: pd.Series) -> pd.Series:
        own = _encoding(path, name)
        return texts.map(lambda t: None if t is None else len(own.encode_ordinary(t))).astype("Int64")

    return F.pandas_udf(run, "long")(text)
