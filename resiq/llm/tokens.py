"""Lengths of texts in tokens of a public tokenizer (byte-level BPE ranks read from a vocabulary file)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default vocabulary; any file of "base64 rank" lines that all executors can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield s.map(lambda x: len(e.encode_ordinary(x)) if x else 0)

    return count(text)


def same_text(text: Column) -> Column:
    """The duplicate cluster of a text: copies up to case and white space share it. 0 for null and blank texts."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit(0)).otherwise(F.xxhash64(plain))


def sized(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, dup) of documents; extra columns are ignored."""
    return docs.select("doc_id", "source", token_count(F.col("text"), path).alias("tokens"), same_text(F.col("text")).alias("dup"))


