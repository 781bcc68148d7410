"""Encoding of a text column with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.tokenizer import bpe_of, read_ranks
from siftline.session import spread

ROWS_PER_BATCH = 1024


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str | None = None) -> DataFrame:
    """One row ``(id_col, ids array<int>)`` per input row, without special tokens.

    Null and empty texts get an empty list; repeated rows and ids each keep their own row; other columns are not read.
    There is no shuffle, and the only thing sent to the executors is the vocabulary file.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))
    source = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_BATCH):
                part = whole.slice(start, ROWS_PER_BATCH)
                packed = [bpe.encode_packed(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
