"""Pluggable tokenizers: text to padded ids and masks, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.vectors import mask_right, pad_right
from stepweave.session import with_package

Tokenizer = Callable[[Sequence[str]], list[list[int]]]
CHUNK_CHARS = 1 << 18


def byte_tokenizer(texts: Sequence[str]) -> list[list[int]]:
    """UTF-8 bytes."""
    return [list(t.encode("utf-8")) for t in texts]


def token_ids(column: Column, tokenizer: Tokenizer, most: int | None = None) -> Column:
    """Ids of whole texts, of which the first ``most`` are handed on.

    The tokenizer gets texts of about ``CHUNK_CHARS`` at a time, so that a batch is never held as Python numbers.
    """
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        given, out = texts.tolist(), [None] * len(texts)

        def fill(places: list[int]) -> None:
            for i, ids in zip(places, tokenizer([given[i] for i in places])):
                out[i] = np.asarray(ids[:most], dtype="int32")

        places, held = [], 0
        for i in np.flatnonzero(texts.notna()).tolist():
            places.append(i)
            held += len(given[i])
            if held >= CHUNK_CHARS:
                fill(places)
                places, held = [], 0
        fill(places)
        return pd.Series(out, index=texts.index, dtype=object)

    return run(column)


def with_tokens(df: DataFrame, column: str, tokenizer: Tokenizer, max_len: int, name: str) -> DataFrame:
    """``name`` (ids cut or zero-padded to max_len) and ``name_mask``."""
    ids = with_package(df).withColumn("_ids", token_ids(F.col(column), tokenizer, max_len))
    return ids.withColumns({name: pad_right(F.col("_ids"), max_len, F.lit(0)),
                            f"{name}_mask": mask_right(F.size("_ids"), max_len)}).drop("_ids")


def with_prefix_postfix(df: DataFrame, prefix: str, postfix: str, tokenizer: Tokenizer, max_len: int) -> DataFrame:
    """Prefix and postfix tokens with three masks: token, autoregressive (1 on postfix), loss (true on postfix)."""
    ids = with_package(df).withColumns({
        "_a": token_ids(F.col(prefix), tokenizer, max_len), "_b": token_ids(F.col(postfix), tokenizer, max_len)})
    n, a = F.size("_a") + F.size("_b"), F.size("_a")
    slots = F.sequence(F.lit(0), F.lit(max_len - 1))
    on_postfix = F.transform(slots, lambda i: (i >= a) & (i < n))
    return ids.withColumns({
        "tokens": pad_right(F.concat("_a", "_b"), max_len, F.lit(0)), "token_mask": mask_right(n, max_len),
        "ar_mask": F.transform(on_postfix, lambda x: x.cast("int")), "loss_mask": on_postfix}).drop("_a", "_b")
