"""Whole corpora as ids of a public byte-pair vocabulary, and back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.llm.byte_pairs import encoder
from sieveloom.plans.runtime import spread

#: The folder of the vocabulary files, the same on all workers.
VOCABULARIES = os.environ.get("SIEVELOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"


def _ids(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [own.encode(text) for text in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = pa.array([i for x in lists for i in x], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=part.schema.names[:1] + ["ids"])

    return encode


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``key`` and ids of every row: no special tokens are added or recognised; null and empty texts have no ids.

    Rows are neither joined nor removed; repeated rows give repeated results.
    """
    schema = T.StructType([documents.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(documents.select(key, text)).mapInArrow(_ids(path), schema)


def _counts(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            sizes = [len(own.encode(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=batch.schema.names[:1] + ["n_tokens"])

    return count


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``key`` and n_tokens of every row; 0 for null and empty texts."""
    schema = T.StructType([documents.schema[key], T.StructField("n_tokens", T.LongType())])
    return spread(documents.select(key, text)).mapInArrow(_counts(path), schema)


def decode(ids: Column, path: str = BYTE_BPE_50K) -> Column:
    """The text of a column of ids; null stays null, no ids give the empty text."""

    @F.udf("string", useArrow=True)
    def text_of(values):
        return None if values is None else "".join(encoder(path).decode(int(i) for i in values))

    return text_of(ids)
