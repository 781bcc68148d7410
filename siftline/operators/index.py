"""The index as tables: postings, document lengths, corpus statistics, hashed vectors; and their maintenance.

``postings(id, term, tf, dl)``, ``lengths(id, dl)`` with a row for every document (also those without a token), ``df(term,
df)`` and the one-row ``stats(n, avgdl)``. Everything is computed over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as tx

DIM = 1024
_CACHE = 200_000


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, tokens)``; a null text has no tokens."""
    return docs.select(F.col(id_col).alias("id"), tx.tokenize(text_col).alias("tokens"))


def lengths(tokenised: DataFrame) -> DataFrame:
    return tokenised.select("id", F.size("tokens").cast("bigint").alias("dl"))


def postings(tokenised: DataFrame) -> DataFrame:
    """``(id, term, tf, dl)``. Terms are counted batch by batch where the documents lie, so there is no shuffle; the work is
    linear in the number of tokens (a document is whole within its row, whatever its length)."""
    kind = tokenised.schema["id"].dataType.simpleString()
    source = tokenised.select("id", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lists = batch.column(1)
                terms = pc.dictionary_encode(lists.flatten())
                dl = np.diff(lists.offsets.to_numpy())
                if not len(terms):
                    continue
                size = len(terms.dictionary)
                key, tf = np.unique(np.repeat(np.arange(batch.num_rows), dl) * size + terms.indices.to_numpy(), return_counts=True)
                owner = key // size
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), terms.dictionary.take(pa.array(key % size)), pa.array(tf), pa.array(dl[owner].astype(np.int64))], ["id", "term", "tf", "dl"])

    return source.mapInArrow(run, f"id {kind}, term string, tf long, dl long")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def statistics(lens: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(n, avgdl)``, one row (or one per scope); an average of 0 counts as 1."""
    agg = [F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl")]
    return lens.groupBy(*scope).agg(*agg) if scope else lens.agg(*agg)


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    """A table of the index without the rows of ``ids(id)``."""
    return table.join(ids, "id", "left_anti")


def upsert(table: DataFrame, fresh: DataFrame, ids: DataFrame) -> DataFrame:
    """A table of the index with the rows of ``ids`` replaced by ``fresh``."""
    return delete(table, ids).unionByName(fresh)


def delta(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(id, change)``: new, changed or removed rows by content hash; both sides have ``(id, hash)``, ids unique."""
    both = current.select("id", F.col("hash").alias("now")).join(indexed.select("id", F.col("hash").alias("before")), "id", "outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    return both.select("id", change.alias("change")).where("change is not null")


def normalise(vector: Column) -> Column:
    """The vector divided by its length, in double; a zero vector stays zero, a null one null."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(as_double, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def hash_batches(batches: Iterator[pa.RecordBatch], dim: int = DIM) -> Iterator[pa.RecordBatch]:
    """``hash_vectors`` for batches ``(id, words)``, one batch for each."""
    known: dict[str, np.ndarray] = {}

    def signed(feature: str) -> int:
        h = zlib.crc32(feature.encode())
        return (h % dim) * 2 + (h >> 31)

    def of_word(w: str) -> np.ndarray:
        got = known.get(w)
        if got is None:
            if len(known) > _CACHE:
                known.clear()
            s = f"#{w}#"
            got = known[w] = np.array([signed("w:" + w), *(signed("c:" + s[i : i + 3]) for i in range(len(w)))])
        return got

    for batch in batches:
        buckets, weights, ends = [], [], [0]
        for words in batch.column(1).to_pylist():
            if words:
                codes = np.concatenate([of_word(w) for w in words] + [np.array([signed(f"b:{a}_{b}") for a, b in zip(words, words[1:])], np.int64)])
                total = np.bincount(codes, minlength=2 * dim).reshape(dim, 2)
                v = total[:, 1] - total[:, 0]
                at = np.flatnonzero(v)
                norm = np.sqrt(float((v * v).sum())) or 1.0
                buckets.append(at)
                weights.append(v[at] / norm)
                ends.append(ends[-1] + len(at))
            else:
                ends.append(ends[-1])
        offsets = pa.array(np.array(ends, np.int32))
        flat = (np.concatenate(buckets) if buckets else np.zeros(0)).astype(np.int32), np.concatenate(weights) if weights else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]], ["id", "buckets", "weights"])


def hash_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """``(id, buckets array<int>, weights array<double>)``: sparse unit vectors of hashed text features, no shuffle.

    A feature adds +1 or -1 (by the top bit of its CRC-32) to bucket CRC-32 mod ``dim``. Buckets that sum to 0 are left
    out; a text without words has an empty vector. Features of a word are hashed once per worker.
    """
    source = docs.select(F.col(id_col).alias("id"), tx.split_words(text_col).alias("words"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lambda batches: hash_batches(batches, dim), f"id {kind}, buckets array<int>, weights array<double>")


def cached(requests: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """Values for all requests, and the rows to add to the cache.

    ``requests(k, text)`` may repeat keys; ``cache(k, v)`` has each key once. ``compute(DataFrame(k, text))`` gives ``(k, v)``
    and is run once for each key that the cache lacks.
    """
    misses = requests.dropDuplicates(["k"]).join(cache, "k", "left_anti")
    fresh = compute(misses)
    return requests.join(cache.unionByName(fresh), "k", "left"), fresh


def merge_cache(cache: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Last write wins: of each key the row with the largest ``order``, that of ``rows`` on ties."""
    both = cache.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)))
    last = both.groupBy("k").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "k"]), F.struct(F.col(order), F.col("_side"))).alias("x"))
    return last.select("k", "x.*").select(*cache.columns)
