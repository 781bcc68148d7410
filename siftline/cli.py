"""``python -m siftline.cli``: draft cases, check them, score retrieval, serve. Exit 1 on errors, 2 on unconfirmed paid work."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline import reports
from siftline.functions import text as tx
from siftline.operators import casegen as cg
from siftline.operators import catalog as ct
from siftline.operators import evals as ev
from siftline.operators import index as ix
from siftline.operators import retrieve as rt
from siftline.session import local_session
from siftline.sources import files, servers


def load_catalog(spark: SparkSession, tools: str | None, config: str | None):
    """The union of a catalog file and of the configured servers' tools, the latter winning; an empty catalog is an error."""
    parts = []
    if tools:
        parts.append(files.read_catalog(spark, tools))
    if config:
        found = servers.configurations(config)
        raw = servers.list_servers(spark, found)
        for r in raw.where("error is not null").collect():
            print(f"{r.server}: {r.error}", file=sys.stderr)
        parts.append(servers.catalog_rows(raw.where("error is null"), spark.createDataFrame(found, servers.SERVER)))
    merged = ct.last_wins(parts).persist() if parts else None
    if merged is None or merged.isEmpty():
        raise SystemExit("the catalog is empty")
    return merged


def complete_with(spec: str | None):
    if not spec:
        raise SystemExit("name a function that answers a prompt: module:function")
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def cmd_draft(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = load_catalog(spark, a.tools, a.mcp).withColumn("params", tx.parameter_list("parameters")).withColumn("grp", tx.group_key("metadata", "tags"))
    docs = rows.select("name", "grp", tx.base_text("name", "description", "params", "tags").alias("text"))
    targets = cg.stratified_sample(docs.select("name", "grp"), "grp", "name", a.n).select(F.col("name").alias("query_id"))
    pairs = rt.siblings(docs.select(F.col("name").alias("id"), "grp", tx.tokenize("text").alias("tokens")), targets)
    shown = rows.select("name", tx.describe("name", "description", "params").alias("shown"))
    asked = cg.prompts(shown, pairs).join(targets.withColumnRenamed("query_id", "name"), "name")
    cache = files.read_cache(spark, a.cache)
    keyed = asked.select(tx.cache_key(F.lit("draft"), F.lit(a.model), F.sha2("prompt", 256)).alias("k"), "prompt")
    print(f"{cg.require_paid(keyed, cache, a.yes)} prompts to answer", file=sys.stderr)
    got, fresh = cg.replies(asked, cache, complete_with(a.complete), a.model)
    if a.cache:
        fresh.write.mode("append").parquet(a.cache)
    known = pairs.groupBy(F.col("query_id").alias("name")).agg(F.collect_list("id").alias("siblings"))
    drafted = cg.drafted_rows(got.join(known, "name", "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>"))))
    files.write_json(drafted.join(rows.select("name", F.col("grp").alias("server")), "name").drop("name").withColumn("status", F.lit("draft")), a.out, "overwrite")
    return 0


def cmd_check(spark: SparkSession, a: argparse.Namespace) -> int:
    cases = files.read_cases(spark, a.cases, allow_draft=True).withColumn("line", F.col("uid") + 1)
    text, errors = reports.lint_text(cg.lint(cases, load_catalog(spark, a.tools, a.mcp), "line", a.overlap, a.allow_draft))
    print(text)
    return int(errors > 0)


def cmd_score(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = load_catalog(spark, a.tools, a.mcp).withColumn("params", tx.parameter_list("parameters"))
    docs = rows.select("name", tx.embedding_text(tx.base_text("name", "description", "params", "tags"), "augmented_description").alias("text"), "tags").persist()
    tok = ix.tokens(docs, "name", "text")
    post = ix.postings(tok).persist()
    tables = {"postings": post, "df": ix.document_frequency(post), "stats": ix.statistics(ix.lengths(tok)), "vectors": ix.hash_vectors(docs, "name", "text"), "docs": docs.select(F.col("name").alias("id"), "tags")}
    cases = ev.scorable(files.read_cases(spark, a.cases, a.allow_draft), a.allow_draft).withColumnRenamed("uid", "query_id")
    asked, wanted = cases.select("query_id", F.col("query").alias("text")), cases.select("query_id", F.col("accept").alias("expected"))
    ks = sorted(int(k) for k in a.k.split(","))
    embed = lambda q: ix.hash_vectors(q, "query_id", "text").withColumnRenamed("id", "query_id")
    metrics = None
    for mode in ("keyword", "semantic", "hybrid"):
        found = rt.search(asked, tables, max(ks), mode, embed=embed, dim=ix.DIM)
        part = ev.retrieval_metrics(wanted, found, ks).withColumn("label", F.lit(mode))
        metrics = part if metrics is None else metrics.unionByName(part)
    metrics = metrics.persist()
    print(reports.text_table(reports.collect(ev.compare(metrics), ("metric", "k"))))
    if a.failures:
        print(reports.text_table(reports.collect(ev.failures(wanted, rt.search(asked, tables, max(ks), "hybrid", embed=embed, dim=ix.DIM)), ("query_id",))))
    if a.out:
        files.write_scores(metrics, a.out)
    return 0


def cmd_serve(spark: SparkSession, a: argparse.Namespace) -> int:
    from siftline.serve import Proxy, start_upstreams

    catalog = ct.Catalog(spark)
    owners = start_upstreams(servers.configurations(a.mcp), catalog)
    Proxy(catalog, owners, a.mode, a.pin or ()).run()
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, f, *more):
        s = sub.add_parser(name)
        s.set_defaults(run=f)
        s.add_argument("--tools", help="catalog file (JSON list)")
        s.add_argument("--mcp", help="configuration of tool servers")
        for flags, options in more:
            s.add_argument(*flags, **options)

    command("draft", cmd_draft, (["--n"], {"type": int, "default": 80}), (["--out"], {"required": True}), (["--model"], {"default": "callable"}), (["--complete"], {}), (["--cache"], {}), (["--yes"], {"action": "store_true"}))
    command("check", cmd_check, (["cases"], {}), (["--overlap"], {"type": float, "default": 0.6}), (["--allow-draft"], {"action": "store_true"}))
    command("score", cmd_score, (["cases"], {}), (["--k"], {"default": "1,3,5,10"}), (["--allow-draft"], {"action": "store_true"}), (["--failures"], {"action": "store_true"}), (["--out"], {}))
    command("serve", cmd_serve, (["--mode"], {"default": "search", "choices": ["search", "dynamic"]}), (["--pin"], {"nargs": "*"}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(local_session(), a)
    except (ValueError, FileNotFoundError, json.JSONDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
