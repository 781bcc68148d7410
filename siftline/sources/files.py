"""JSON and JSON-lines sources and sinks with fixed schemas."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import materialise, numbered

CASE = "query string, expected string, kind string, server string, status string, target_original_name string, confused_with string, also_accept array<string>, review_note string, original_query string"
RUN = (
    "condition string, i bigint, query string, kind string, server string, expected array<string>, also_accept array<string>, n_tools bigint, retrieved bigint, tool string, correct bigint, "
    "input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint, latency_s double, cost_list double, cost_effective double, reported_cost double, stop_reason string, text string, error string"
)


def as_list(c):
    """``expected`` of a case line: a JSON list, or a bare string as a list of one; null stays null."""
    return F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(c))


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON list of catalog rows, or with ``lines`` one row a line, which many tasks can read; parameters stay the text they are."""
    from siftline.operators.catalog import SCHEMA

    return spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)


def read_cases(spark: SparkSession, path: str, allow_draft: bool = False) -> DataFrame:
    """Cases of a JSON-lines file with ``uid``, their place among its non-blank lines, given before rows are left out.

    Kept are rows of status ok, or any but dropped with ``allow_draft``; a missing status is ok. Keys that the schema does
    not know are ignored.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    # the place of a line is that of its file, of its block there and of it in the block
    placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = numbered(placed, "_file", "_block", "_line").select("uid", F.from_json("value", CASE).alias("c")).select("uid", "c.*").withColumn("expected", as_list("expected"))
    return filter_status(rows, allow_draft)


def filter_status(rows: DataFrame, allow_draft: bool = False) -> DataFrame:
    status = F.lower(F.coalesce("status", F.lit("ok")))
    return rows.where(status != "dropped" if allow_draft else status == "ok")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records; of a condition's query the line read last counts (``_file``, then place in it)."""
    from siftline.operators.stats import last_per_query

    rows = spark.read.schema(RUN).json(path).withColumn("_order", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return last_per_query(rows, ("condition", "i"), "_order").drop("_order")


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_runs(df: DataFrame, path: str) -> None:
    """One folder per condition; a re-run overwrites the folders of its own conditions only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(path)


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """The cache ``(k, v)`` in a folder; an empty one if there is none yet. What is read is copied, so the folder may be appended to."""
    schema = "k string, v string"
    if not path:
        return spark.createDataFrame([], schema)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return materialise(spark.read.schema(schema).parquet(path), "cache")


def write_scores(df: DataFrame, path: str) -> None:
    """A metric table as one JSON list, all of its rows, written as they arrive."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(df.toLocalIterator()):
            f.write((",\n" if i else "\n") + json.dumps(r.asDict(recursive=True)))
        f.write("\n]")


def merge_summary(old: dict, new: dict, limit: int | None) -> dict:
    """Summaries by model after a run; a run over a part of the cases must not relabel what a whole run has written."""
    merged = dict(old)
    for model, entry in new.items():
        before = merged.get(model, {})
        keep = {k: v for k, v in before.items() if k != "conditions"} if limit and before else {}
        merged[model] = entry | keep | {"conditions": before.get("conditions", {}) | entry.get("conditions", {})}
    return merged


def blankless(lines: Iterable[str]) -> list[dict]:
    return [json.loads(x) for x in lines if x.strip()]
