"""Texts as padded ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def padded(rows: DataFrame, text: str, length: int, path: str = VOCABULARY, pad: int = 0) -> DataFrame:
    """Adds input_ids and attention_mask of one length (ids beyond it are cut, the rest is padded on the right) and
    n_tokens of the whole text. NULL counts as the empty text. The vocabulary is read once a worker."""

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>, n_tokens int")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in texts:
            ids = [coder.encode_ordinary(t) if t else [] for t in s]
            yield pd.DataFrame({"input_ids": [(x + [pad] * length)[:length] for x in ids], "attention_mask": [[int(k < len(x)) for k in range(length)] for x in ids], "n_tokens": [len(x) for x in ids]})

    return rows.withColumn("_t", encode(F.col(text))).select(*rows.columns, "_t.input_ids", "_t.attention_mask", "_t.n_tokens")
