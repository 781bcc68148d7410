"""Keeping the index up to date from a stream of catalog changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators import index as ix

TABLES = ("rows", "postings", "lengths", "vectors")


class IndexStore:
    """The index as versioned Parquet tables in a folder all executors share.

    A version is written beside the last one and becomes current when its marker file is there: the marker of the highest
    number counts, and none is ever moved or overwritten, so a reader always sees a whole version and a job that fails at
    any point leaves the last one in place. Then all versions before the last but one are removed, with their markers. A
    version belongs to a batch of the stream: a batch that runs again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The numbers of the whole versions, in order."""
        found = self._fs.globStatus(self._fs_path(f"{self.path}/whole-*"))
        return sorted(int(x.getPath().getName().split("-")[1]) for x in found or [])

    def read(self) -> dict[str, DataFrame] | None:
        known = self.batches()
        return {t: self.spark.read.parquet(f"{self.path}/batch-{known[-1]}/{t}") for t in TABLES} if known else None

    def write(self, tables: dict[str, DataFrame], batch: int) -> None:
        for t in TABLES:
            tables[t].write.mode("overwrite").parquet(f"{self.path}/batch-{batch}/{t}")
        self._fs.create(self._fs_path(f"{self.path}/whole-{batch}"), True).close()
        for old in self.batches()[:-2]:  # the last but one may still be read
            self._fs.delete(self._fs_path(f"{self.path}/whole-{old}"), False)
            self._fs.delete(self._fs_path(f"{self.path}/batch-{old}"), True)

    def done(self, batch: int) -> bool:
        known = self.batches()
        return bool(known) and known[-1] >= batch


def apply_changes(store: IndexStore, changes: DataFrame, batch: int) -> None:
    """One batch of ``changes(name, text, hash, removed, seq)``: of each name the last change counts.

    Rows whose hash is that of the index are left alone; the others are tokenised and hashed anew, and replace the old rows
    in every table.
    """
    if store.done(batch):
        return
    last = changes.groupBy("name").agg(F.max_by(F.struct("text", "hash", "removed"), "seq").alias("x")).select(F.col("name").alias("id"), "x.*")
    now = store.read()
    if now is not None:
        same = last.join(now["rows"].select("id", F.col("hash").alias("before")), "id").where("not removed and hash = before").select("id")
        last = last.join(same, "id", "left_anti")
    fresh = last.where("not removed")
    tok = ix.tokens(fresh, "id", "text")
    tables = {"rows": fresh.select("id", "hash"), "postings": ix.postings(tok), "lengths": ix.lengths(tok), "vectors": ix.hash_vectors(fresh, "id", "text")}
    if now is not None:
        ids = last.select("id")
        tables = {t: ix.upsert(now[t], tables[t], ids) for t in TABLES}
    store.write(tables, batch)


def follow(stream: DataFrame, store: IndexStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; with ``once`` it ends when all that is there has been processed."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: apply_changes(store, df, batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
