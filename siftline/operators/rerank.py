"""Picking one row of a shortlist: the reranker protocol, request and response of a choice model, routing, cascade."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import materialise
from siftline.sources.formats import quote

NO_TOOL = "none"
MAX_OPTIONS = 255
INSTRUCTIONS = "The state is what a user asked an assistant for. Choose the tool to call for it, or none if no listed tool can do it."
NEEDS_TOOL = "Does this request need a tool or service to be called, or only a reply?"
NONE_TEXT = "No listed tool can carry out this request."
DECISION = "query_id bigint, pick string, confidence double, ranked array<struct<name:string,prob:double>>, needs_tool double"


def rerank(shortlists: DataFrame, fn: Callable[[str, list[dict]], dict]) -> DataFrame:
    """Decisions by a user function for ``shortlists(query_id, query, id, option, rank)``.

    ``fn(query, candidates)`` gets the candidates best first as dicts of ``name`` and ``option`` and returns ``pick``,
    ``confidence``, ``ranked`` and ``needs_tool``, all optional. A shortlist is at most a few hundred rows. A query whose
    candidates are missing has no row here.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        got = fn(rows["query"].iloc[0], [{"name": n, "option": o} for n, o in zip(rows["id"], rows["option"])]) or {}
        ranked = [{"name": n, "prob": float(p)} for n, p in got.get("ranked") or []]
        return pd.DataFrame([{"query_id": rows["query_id"].iloc[0], "pick": got.get("pick"), "confidence": got.get("confidence"), "ranked": ranked, "needs_tool": got.get("needs_tool")}])

    return shortlists.select("query_id", "query", "id", "option", "rank").groupBy("query_id").applyInPandas(one, DECISION)


def requests(shortlists: DataFrame, model: str, ask_needs_tool: bool = False) -> DataFrame:
    """``(query_id, body)``: the request of a choice model as JSON, options in the order of rank and ``none`` at the end.

    More than ``MAX_OPTIONS`` options fail the job.
    """
    held = shortlists.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "option"))).alias("c"))
    size = F.size("c")
    held = held.withColumn("c", F.when(size >= MAX_OPTIONS, F.raise_error(F.concat(F.lit("too many options: "), size.cast("string"))).cast(held.schema["c"].dataType)).otherwise(F.col("c")))
    options = F.array_join(F.transform("c", lambda x: F.concat(quote(x["id"]), F.lit(":"), quote(x["option"]))), ",")
    parts = [F.lit('{"model":'), quote(F.lit(model)), F.lit(',"state":'), quote(F.col("query")), F.lit(',"questions":{"tool":{"type":"choice","instructions":'), quote(F.lit(INSTRUCTIONS))]
    parts += [F.lit(',"criteria":{'), options, F.lit(',"none":'), quote(F.lit(NONE_TEXT)), F.lit("}}")]
    if ask_needs_tool:
        parts += [F.lit(',"needs_tool":{"type":"noul","instructions":'), quote(F.lit(NEEDS_TOOL)), F.lit("}")]
    return held.select("query_id", F.concat(*parts, F.lit("}}")).alias("body"))


def http_sender(url: str, key: str | None = None, timeout: float = 30.0) -> Callable[[str], str]:
    """A function that posts a request body to a choice model and returns the answer's body.

    It raises a RuntimeError with the status and the beginning of the body for an answer that is no success, and with the
    reason if there is no answer in ``timeout`` seconds.
    """
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

    def send(body: str) -> str:
        try:
            with urlopen(Request(url, data=body.encode(), headers=headers, method="POST"), timeout=timeout) as answer:  # noqa: S310
                return answer.read().decode()
        except HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {e.read(500).decode('utf-8', 'replace')}") from e
        except (URLError, OSError) as e:
            raise RuntimeError(f"no answer: {getattr(e, 'reason', e)}") from e

    return send


def send_requests(bodies: DataFrame, send: Callable[[str], str]) -> DataFrame:
    """``(query_id, body, error)`` of ``bodies(query_id, body)``: each is sent once, now, and the answers are written.

    What fails has a null body and its error; a null body is not sent and has neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for body in batch.column(1).to_pylist():
                answer = error = None
                try:
                    answer = None if body is None else send(body)
                except Exception as e:  # noqa: BLE001 - the error is the row's result
                    error = str(e) or type(e).__name__
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["query_id", "body", "error"])

    source = bodies.select("query_id", "body")
    return materialise(source.mapInArrow(run, f"query_id {source.schema['query_id'].dataType.simpleString()}, body string, error string"), "answers")


def parse_response(responses: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(query_id, pick, confidence, ranked, needs_tool)`` of ``responses(query_id, body)``.

    The answer may be wrapped in ``result``. The confidence is the pick's probability, else the stated one. ``none`` and, if
    ``names(query_id, id)`` is given, picks that were no candidate become null. A body that does not parse gives nulls.
    """
    body = F.coalesce(F.get_json_object("body", "$.result"), F.col("body"))
    answer = F.get_json_object(body, "$.answers.tool")
    probs = F.from_json(F.get_json_object(answer, "$.probabilities"), "map<string,double>")
    rows = responses.select("query_id", F.get_json_object(answer, "$.choice").alias("choice"), F.get_json_object(answer, "$.confidence").try_cast("double").alias("stated"), probs.alias("probs"), F.get_json_object(body, "$.answers.needs_tool.noul").try_cast("double").alias("needs_tool"))
    ordered = F.array_sort(F.transform(F.map_entries("probs"), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("name"))))
    ranked = F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), (-x["neg"]).alias("prob")))
    out = rows.select(
        "query_id", F.when(F.col("choice") != NO_TOOL, F.col("choice")).alias("pick"), F.coalesce(F.try_element_at("probs", F.col("choice")), "stated").alias("confidence"),
        F.coalesce(ranked, F.array().cast("array<struct<name:string,prob:double>>")).alias("ranked"), "needs_tool",
    )
    if names is not None:
        known = names.select("query_id", F.col("id").alias("pick"), F.lit(True).alias("_known")).distinct()
        out = out.join(known, ["query_id", "pick"], "left").withColumn("pick", F.when(F.col("_known"), F.col("pick"))).drop("_known").select("query_id", "pick", "confidence", "ranked", "needs_tool")
    return out


def top_names(ranked: Column | str, n: int = 3) -> Column:
    """The n likeliest names without ``none``: a short list to hand on when the confidence is low."""
    c = F.col(ranked) if isinstance(ranked, str) else ranked
    return F.slice(F.filter(F.transform(c, lambda x: x["name"]), lambda x: x != NO_TOOL), 1, n)


def cascade(first: DataFrame, second: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``(query_id, pick, used, error)``: the first decision, or the second where the first is unsure or picked nothing.

    ``first(query_id, pick, confidence)``, ``second(query_id, pick, error)``; a failure of the second counts only where it
    is used, and then there is no pick.
    """
    both = first.select("query_id", F.col("pick").alias("p1"), F.col("confidence").alias("c1")).join(second.select("query_id", F.col("pick").alias("p2"), F.col("error").alias("e2")), "query_id", "left")
    use = (F.coalesce("c1", F.lit(0.0)) < threshold) | F.col("p1").isNull()
    error = F.when(use, F.nullif(F.col("e2"), F.lit("")))
    return both.select("query_id", F.when(use, F.when(error.isNull(), F.col("p2"))).otherwise(F.col("p1")).alias("pick"), F.when(use, "second").otherwise("first").alias("used"), error.alias("error"))


def group_documents(catalog: DataFrame, max_chars: int = 3000) -> DataFrame:
    """``(id, text)``: one document per group of ``catalog(name, grp)``, its key and its members' names in order.

    Names are cut to what a description may hold; only as many as can fit are gathered.
    """
    w = Window.partitionBy("grp").orderBy("name")
    # no more than a third of max_chars names can fit, so a large group is cut before the shuffle
    first = catalog.where("name is not null and name <> ''").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_chars // 3 + 1)
    upto = first.select("grp", "name").withColumn("chars", F.sum(F.length("name") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("chars") <= max_chars)
    held = upto.groupBy("grp").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return held.select(F.col("grp").alias("id"), F.concat(F.col("grp"), F.lit(" tools: "), F.array_join("names", ", ")).alias("text"))


def route(queries: DataFrame, group_picks: DataFrame, within: Callable[[DataFrame, DataFrame], DataFrame], catalog: DataFrame) -> DataFrame:
    """Two stages: ``group_picks(query_id, grp)`` narrows the catalog, then ``within(queries, shown(query_id, id))`` picks.

    ``(query_id, grp, id, score)``; a query without a group has nulls, as does one whose group gives no pick.
    """
    shown = group_picks.join(catalog.select("name", "grp"), "grp").select("query_id", F.col("name").alias("id"))
    picked = within(queries, shown)
    return queries.select("query_id").join(group_picks.select("query_id", "grp"), "query_id", "left").join(picked, "query_id", "left")
