"""Token counts by a public tokenizer.

The vocabulary file stays where it is installed; its path is a parameter. Each Python worker loads it once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary (ranks of a byte-level BPE) and the pattern that splits text before merging (fixed value).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(path: str = RANKS):
    """The tokenizer of a ranks file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep`` and ``n_tokens`` (0 for null and empty texts) of every row with an id."""
    schema = f"id bigint, {''.join(f'{c} {dict(documents.dtypes)[c]}, ' for c in keep)}n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            b["n_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield b[["id", *keep, "n_tokens"]]

    return documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *keep, F.col(text_col).alias("text")).mapInPandas(run, schema)
