"""Objects from short specifications, ``kind`` or ``kind:argument``: embedders and pickers. Remote ones need a callback."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.operators import index as ix
from siftline.operators.rerank import http_sender

EMBED_ROWS = 128


def http_embedder(url: str, model: str, key: str | None = None, timeout: float = 60.0) -> Callable[[list[str]], list[list[float]]]:
    """A function that has texts embedded by a service that takes ``model`` and ``input`` and answers with ``data``, whose
    entries tell by ``index`` which text they are for, in any order."""
    send = http_sender(url, key, timeout)

    def embed(texts: list[str]) -> list[list[float]]:
        data = json.loads(send(json.dumps({"model": model, "input": texts})))["data"]
        at = {d["index"]: d["embedding"] for d in data}
        if set(at) != set(range(len(texts))):
            raise RuntimeError(f"{len(data)} vectors for {len(texts)} texts")
        return [at[i] for i in range(len(texts))]

    return embed


def embedded(rows: DataFrame, id_col: str, text_col: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``(id_col, v array<double>)`` by a function on batches of at most ``EMBED_ROWS`` texts; unit length.

    A null text is an empty one; a zero vector stays zero. An error of the function ends the job.
    """
    source = rows.select(rows[id_col].alias("id"), rows[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, EMBED_ROWS):
                part = whole.slice(at, EMBED_ROWS)
                v = np.asarray(embed([t or "" for t in part.column(1).to_pylist()]), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v /= np.where(norm == 0, 1.0, norm)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, v array<double>").withColumnRenamed("id", id_col)


def embedder(spec: str, remote: Callable[[str, DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """``hashing`` or ``hashing:<dim>`` gives (query_id, buckets, weights) for (query_id, text); other kinds call ``remote``."""
    kind, _, argument = spec.partition(":")
    if kind == "hashing":
        dim = int(argument or ix.DIM)
        return lambda q: ix.hash_vectors(q, "query_id", "text", dim).withColumnRenamed("id", "query_id")
    if remote is None:
        raise ValueError(f"embedder {spec!r} needs a callback")
    return lambda q: remote(argument or kind, q)


def picker(spec: str, remote: dict[str, Callable] | None = None) -> Callable:
    """``first`` picks the first candidate; other kinds are looked up among ``remote`` and given the argument."""
    kind, _, argument = spec.partition(":")
    if kind == "first":
        return lambda query, candidates: {"pick": candidates[0]["name"] if candidates else None, "confidence": None}
    if not remote or kind not in remote:
        raise ValueError(f"unknown picker {spec!r}")
    return remote[kind](argument)
