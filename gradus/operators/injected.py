"""Columns from stored tables or from a function of the caller: vectors and model responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prompts that the caller's function gets at a time.
PROMPTS = 500


def with_embeddings(df: DataFrame, key: str, text: str, stored: DataFrame | None = None, fn: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """df with `vector`: joined from stored (key, vector), else computed by fn, a batch of texts at a time."""
    if fn is not None:
        return df.withColumn("vector", F.pandas_udf(fn, "array<float>")(F.col(text)))
    return df.join(stored.select(key, "vector"), key, "left")


def with_responses(df: DataFrame, key: str, prompt: str, stored: DataFrame | None = None, fn: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """df with `response`: looked up in stored (key, response), null on a miss, else asked of fn, a batch of prompts at a time."""
    if fn is None:
        return df.join(stored.select(key, "response"), key, "left")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PROMPTS):
                rows = batch.slice(at, PROMPTS)
                answers = pa.array(list(fn(rows.column(prompt).to_pylist())), pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, answers], names=[*rows.schema.names, "response"])

    return df.mapInArrow(ask, T.StructType([*df.schema.fields, T.StructField("response", T.StringType())]))
