"""Vector stores: the contract, the store kept in tables, and batches sent to a store elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import index as ix
from siftline.operators import retrieve as rt
from siftline.session import materialise

ITEMS = "id string, v array<double>"
SEND_ROWS = 500


@runtime_checkable
class VectorStore(Protocol):
    """What an index needs of a store. ``items`` are ``(id, v)``, ``ids`` are ``(id)``, queries ``(query_id, v)``.

    Equal ids: the last write counts. Similarity is the cosine. Ids that are not there are ignored.
    """

    def upsert(self, items: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, id, score, rank)``, exact or not, as the store does it."""

    def contained(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that are there, each once."""

    def count(self) -> int: ...


class TableStore:
    """Vectors in a table of the shared folder, unit length, exact search. Changes replace the table; null vectors are dropped."""

    def __init__(self, spark: SparkSession):
        self.table = spark.createDataFrame([], ITEMS)

    def upsert(self, items: DataFrame) -> None:
        last = items.where("id is not null and v is not null").withColumn("_n", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by("v", "_n").alias("v"))
        fresh = materialise(last.select("id", ix.normalise(F.col("v")).alias("v")), "vectors")
        self.table = materialise(ix.upsert(self.table, fresh, fresh.select("id")), "vectors")

    def delete(self, ids: DataFrame) -> None:
        self.table = materialise(ix.delete(self.table, ids), "vectors")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return rt.dense_top(queries, self.table, k)

    def contained(self, ids: DataFrame) -> DataFrame:
        return self.table.join(ids.select("id").distinct(), "id", "left_semi").select("id")

    def count(self) -> int:
        return self.table.count()


def send_items(items: DataFrame, connect: Callable[[], Callable[[list[str], list[list[float]]], None]]) -> int:
    """Writes ``(id, v)`` to a store elsewhere, from the executors, and returns how many rows were sent.

    ``connect`` is called once a task and gives the function that writes a batch of at most ``SEND_ROWS`` rows. It must
    replace what has the same id, as a task that is run again sends its rows again. An error ends the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, n = connect(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, SEND_ROWS):
                part = whole.slice(at, SEND_ROWS)
                write(part.column(0).to_pylist(), part.column(1).to_pylist())
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    sent = items.where("id is not null and v is not null").select("id", "v").mapInArrow(run, "n long")
    return sent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
