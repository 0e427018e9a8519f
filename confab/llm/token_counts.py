"""Token counts by a finite-state compilation of a BPE vocabulary (see transducer)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import by_text
from .transducer import TokenCounter


@lru_cache(2)
def _counter(model_file: str, table_mb: int) -> TokenCounter:
    return TokenCounter(model_file, table_mb)  # kept by a worker from task to task


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_mb: int = 160) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row's whole text.

    One pass without a shuffle. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row
    each; very long texts are counted whole, in time that grows with their length; an empty table gives none; other columns
    aren't read. model_file must be readable on every worker; table_mb
    bounds a worker's transition table, which restarts when full."""

    def make(rest, found):
        n = _counter(model_file, table_mb).count(found)
        return {
            id_col: rest[id_col],
            "n_bytes": np.array([len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in found], np.int64),
            "n_tokens": n,
            "over_limit": n > limit,
        }

    kind = dict(docs.dtypes)[id_col]
    return by_text(docs, [id_col], f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", make, text_col)
