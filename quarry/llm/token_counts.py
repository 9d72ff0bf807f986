"""Token counts: pre-tokens proven to be one token are counted by lookup; only the rest is merged."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import sliced, worker_cache
from quarry.llm.bpe import Encoder


def encoder(json_text: str) -> Encoder:
    """The encoder of a vocabulary, made once in a worker."""
    cache = worker_cache()
    key = ("encoder", hash(json_text))
    if key not in cache:
        cache[key] = Encoder(json_text)
    return cache[key]


def vocabulary(spark, path: str):
    """The text of a vocabulary file, sent to the executors once; its size is that of the file (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def token_counts(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with a long column `out`: the tokens of the whole text under a tokenizers .json vocabulary.

    No begin, end or added special tokens; special strings inside a text as the library has them by default. A null
    or empty text has 0. Repeated rows count each by itself; an empty table gives an empty result. A column of df
    that has the name `out` is replaced; other columns stay.
    """
    spark = df.sparkSession
    vocab = vocabulary(spark, vocabulary_path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = encoder(vocab.value).count
        for texts in sliced(batches):
            yield pd.Series([n(t) for t in texts], dtype="int64")

    return df.withColumn(out, count(F.col(text)))
