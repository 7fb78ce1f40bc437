"""Corpus encoding (problem 8) and token budgets (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thazin.llm import bpe
from thazin.session import built, shared


def _vocabulary(spark: SparkSession, vocabulary: str):
    """The vocabulary file as a broadcast: about 1 MB, whatever the data."""
    return shared(spark, Path(vocabulary).read_bytes())


def ids_of(spark: SparkSession, text: Column, vocabulary: str = bpe.VOCABULARY) -> Column:
    handle = _vocabulary(spark, vocabulary)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = built(handle, bpe.encoder)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts], dtype=object)

    return encode(text)


def tokens_of(spark: SparkSession, text: Column, vocabulary: str = bpe.VOCABULARY) -> Column:
    handle = _vocabulary(spark, vocabulary)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = built(handle, bpe.counter)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int32")

    return count(text)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(id, ids) for every row, by the segment-tree encoder.

    A null or empty text gives the empty list, never null.  Special tokens
    are ordinary text.  Rows are neither dropped nor merged; a null or
    repeated id is kept as it is.  No shuffle: each text is encoded where it
    was read.
    """
    return df.select(F.col(id_col), F.col(text_col).alias("_text")).select(id_col, ids_of(df.sparkSession, F.col("_text"), vocabulary).alias("ids"))


def token_budget(
    df: DataFrame,
    id_col: str = "fert_id",
    text_col: str = "text",
    words_col: str = "denominators.words",
    by: tuple[str, ...] = ("source", "lang", "domain"),
    order_col: str | None = "ingested_at",
    vocabulary: str = bpe.VOCABULARY,
) -> DataFrame:
    """Token totals over the cube of ``by``, every id once.

    Of repeated ids the row with the least ``order_col`` counts, ties broken
    by the other values.  A null text has 0 tokens.  Null groups are kept:
    ``total_<c>`` is true where a row sums over all values of c, so that it
    differs from the group whose c is null.  ``tokens_per_word`` is taken over
    the rows with a positive word count and a non-empty text only, and is null
    where there are none.  A row with a null id is a record of its own.

    The count runs before the shuffle, which then moves only numbers and the
    group columns; the cube is expanded after one row per id is left and
    after a first aggregation to the finest groups.
    """
    k = [f"_g{i}" for i in range(len(by))]
    rows = df.select(
        F.col(id_col).alias("_id"),
        *(F.col(c).cast("string").alias(a) for c, a in zip(by, k)),
        (F.col(order_col) if order_col else F.lit(0)).alias("_order"),
        F.col(words_col).cast("long").alias("_words"),
        F.col(text_col).alias("_text"),
    )
    counted = rows.select("_id", *k, "_order", "_words", tokens_of(df.sparkSession, F.col("_text"), vocabulary).cast("long").alias("_tokens"))
    # rows without an id are spread and stay apart
    one = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())
    least = counted.groupBy("_id", one.alias("_one")).agg(F.min(F.struct("_order", *k, "_tokens", "_words")).alias("r")).select("r.*")
    usable = (F.col("_words") > 0) & (F.col("_tokens") > 0)
    finest = least.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_tokens").alias("t"), F.sum(F.when(usable, F.col("_tokens"))).alias("ut"), F.sum(F.when(usable, F.col("_words"))).alias("uw")
    )
    cube = finest.cube(*k).agg(
        F.sum("n").alias("n_docs"), F.sum("t").alias("tokens"), F.sum("ut").alias("ut"), F.sum("uw").alias("usable_words"), *((F.grouping(a) == 1).alias(f"total_{c}") for c, a in zip(by, k))
    )
    return cube.select(
        *(F.col(a).alias(c) for c, a in zip(by, k)), *(f"total_{c}" for c in by), "n_docs", "tokens", "usable_words", (F.col("ut") / F.col("usable_words")).alias("tokens_per_word")
    )
