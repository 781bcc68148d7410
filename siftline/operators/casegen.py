"""Data-set jobs around an evaluation: stratified samples, drafts to cases, linting, subsets, cost projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as tx
from siftline.session import materialise, numbered

DRAFT = T.StructType(
    [
        T.StructField("direct", T.ArrayType(T.StringType())),
        T.StructField("confusable", T.StructType([T.StructField("query", T.StringType()), T.StructField("confused_with", T.StringType())])),
        T.StructField("multi", T.StructType([T.StructField("query", T.StringType()), T.StructField("also", T.StringType())])),
    ]
)
# What the drafter is asked for follows from DRAFT, the shape of a reply.
PROMPT = """TARGET is the definition of one tool. SIBLINGS are definitions of tools that share its group.

Draft test messages for a tool search. Each must read like something a person types into a chat window without knowing that
tools exist: no identifiers, no phrases lifted from the definitions, concrete made-up names, dates and amounts where they help.

The reply is read by a program that knows three keys, {"direct": [], "confusable": {}, "multi": {}}, and takes no other text:
- "direct": a list of 2 strings, messages that TARGET alone can serve.
- "confusable": an object. Its "query" is a message that seems to fit one of SIBLINGS at first sight but can only be served by
  TARGET; its "confused_with" is the name of that sibling.
- "multi": an object whose "query" is a message that takes TARGET for the first step and one of SIBLINGS for the second, and
  whose "also" is the name of that sibling; null if no sibling makes sense as a second step.

TARGET:
{target}

SIBLINGS:
{siblings}"""


def stratified_sizes(groups: DataFrame, n: int) -> DataFrame:
    """``(grp, size, k)``: rows to draw of each group, its share of n rounded half to even, two at least, never more than it has."""
    total = groups.agg(F.sum("size").alias("total"))
    share = F.bround(F.lit(float(n)) * F.col("size") / F.col("total"), 0).cast("bigint")
    return groups.join(F.broadcast(total)).select("grp", "size", F.least("size", F.greatest(F.least(F.lit(2), "size"), share)).alias("k"))


def stratified_sample(rows: DataFrame, grp: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """About n rows, spread over groups by size; within a group in the order of md5(seed, key), so that it can be repeated."""
    sizes = stratified_sizes(rows.groupBy(F.col(grp).alias("grp")).agg(F.count("*").alias("size")), n)
    w = Window.partitionBy(grp).orderBy(draw(seed, F.col(key)), key)
    # no group gives more than n rows, so the rank limit holds before the shuffle too
    drawn = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(2, n))
    return drawn.join(sizes.select(F.col("grp").alias(grp), "k"), grp).where("_rn <= k").drop("_rn", "k")


def draw(seed: int, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def prompts(shown: DataFrame, pairs: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """``(name, prompt)`` from ``shown(name, shown)`` and ``pairs(query_id, id, rank)``, a target's siblings in their order."""
    near = pairs.join(shown.select(F.col("name").alias("id"), "shown"), "id").groupBy(F.col("query_id").alias("name")).agg(F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("s"))
    text = F.coalesce(F.array_join(F.transform("s", lambda x: x["shown"]), "\n\n"), F.lit("(none)"))
    filled = F.replace(F.replace(F.lit(prompt), F.lit("{siblings}"), text), F.lit("{target}"), F.col("shown"))
    return shown.join(near, "name", "left").select("name", filled.alias("prompt"))


def drafted_rows(replies: DataFrame) -> DataFrame:
    """``(name, query, expected, kind, confused_with)`` of ``replies(name, reply, siblings array<string>)``.

    Fences are stripped; a reply that is null or does not parse gives no rows. An invented sibling of a confusable case
    becomes null; a two-step case is kept only if its second tool is a known sibling.
    """
    parsed = replies.select("name", "siblings", F.from_json(tx.strip_fences("reply"), DRAFT).alias("d"))
    direct = parsed.select("name", F.explode("d.direct").alias("query")).select("name", "query", F.array("name").alias("expected"), F.lit("direct").alias("kind"), F.lit(None).cast("string").alias("confused_with"))
    with_ = F.col("d.confusable.confused_with")
    confusable = parsed.where("d.confusable.query <> ''").select(
        "name", F.col("d.confusable.query").alias("query"), F.array("name").alias("expected"), F.lit("confusable").alias("kind"), F.when(F.array_contains("siblings", with_), with_).alias("confused_with")
    )
    multi = parsed.where("d.multi.query <> '' and array_contains(siblings, d.multi.also)").select(
        "name", F.col("d.multi.query").alias("query"), F.array("name", "d.multi.also").alias("expected"), F.lit("multi").alias("kind"), F.lit(None).cast("string").alias("confused_with")
    )
    return direct.unionByName(confusable).unionByName(multi)


def replies(requests: DataFrame, cache: DataFrame, complete: Callable[[str], str | None], model: str) -> tuple[DataFrame, DataFrame]:
    """``(name, reply)`` for ``requests(name, prompt)`` and the replies to add to the cache ``(k, v)``.

    ``complete`` is called once for each prompt the cache lacks; a call that fails or gives nothing has a null reply, which
    is not cached. The calls are made now and their replies written to the shared folder, so that nothing read later pays
    for them again. The caller appends the second table to its cache before it goes on.
    """
    keyed = requests.withColumn("k", tx.cache_key(F.lit("draft"), F.lit(model), F.sha2("prompt", 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(1).to_pylist():
                try:
                    out.append(complete(p))
                except Exception:  # noqa: BLE001 - one failed call must not end the job
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["k", "v"])

    missing = keyed.select("k", "prompt").dropDuplicates(["k"]).join(cache, "k", "left_anti")
    fresh = materialise(missing.mapInArrow(run, "k string, v string").where("v is not null"), "replies")
    return keyed.join(cache.unionByName(fresh), "k", "left").select("name", F.col("v").alias("reply")), fresh


def lint(cases: DataFrame, catalog: DataFrame, line: str, overlap: float = 0.6, allow_draft: bool = False, min_per_group: int = 3) -> DataFrame:
    """``(severity, rule, line, detail)`` of all rules; ``cases`` has the case columns and ``line``, its order of arrival.

    ``catalog(name, description, augmented_description)`` has each name once. Dropped rows are left out; lines are those of
    ``line``. A null query is skipped by the rules on queries.
    """
    rows = cases.where(F.lower(F.coalesce("status", F.lit("ok"))) != "dropped").withColumn("line", F.col(line))
    parts = [
        unknown_tools(rows, catalog).select(F.lit("error").alias("severity"), F.lit("unknown_tool").alias("rule"), "line", F.col("name").alias("detail")),
        duplicates(rows).select(F.lit("error").alias("severity"), F.lit("duplicate").alias("rule"), "line", F.col("first_line").cast("string").alias("detail")),
        leakage(rows, catalog, overlap).select(F.lit("warning").alias("severity"), F.concat(F.lit("leak_"), "source").alias("rule"), "line", F.col("share").cast("string").alias("detail")),
        thin_groups(rows, min_per_group).select(F.lit("warning").alias("severity"), F.lit("thin_group").alias("rule"), F.lit(None).cast("bigint").alias("line"), F.col("grp").alias("detail")),
    ]
    if not allow_draft:
        parts.append(not_reviewed(rows).select(F.lit("error").alias("severity"), F.lit("status").alias("rule"), "line", F.col("status").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unknown_tools(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    named = rows.select("line", F.explode(F.concat(F.coalesce("expected", none), F.coalesce("also_accept", none))).alias("name"))
    return named.join(catalog.select("name"), "name", "left_anti").select("line", "name")


def duplicates(rows: DataFrame) -> DataFrame:
    """``(line, first_line)`` of rows whose query stood before, trimmed and in lower case.

    The first line of each query is aggregated (so a query that a third of all rows share is combined in the map stage) and
    joined back.
    """
    q = rows.where("query is not null").select("line", F.sha2(F.lower(F.trim("query")), 256).alias("q"))
    first = q.groupBy("q").agg(F.min("line").alias("first_line"), F.count("*").alias("n")).where("n > 1").drop("n")
    return q.join(first, "q").where("line > first_line").select("line", "first_line")


def not_reviewed(rows: DataFrame) -> DataFrame:
    return rows.where(F.lower(F.coalesce("status", F.lit("ok"))) != "ok").select("line", "status")


def leakage(rows: DataFrame, catalog: DataFrame, overlap: float) -> DataFrame:
    """``(line, source, share)``: queries whose words (longer than two letters, repeats counted) mostly stand in the text of
    the first expected row, or in its augmented description."""
    words = F.filter(tx.tokenize("query"), lambda t: F.length(t) > 2)
    q = rows.where("query is not null").select("line", F.get("expected", F.lit(0)).alias("name"), words.alias("w")).where("size(w) > 0")
    known = catalog.select("name", tx.tokenize(F.concat_ws(" ", "name", "description")).alias("own"), F.when(F.col("augmented_description") != "", tx.tokenize("augmented_description")).alias("augmented"))
    both = q.join(known, "name")
    share = lambda c: F.size(F.filter("w", lambda t: F.array_contains(F.col(c), t))) / F.size("w")
    marked = F.array(F.struct(F.lit("text").alias("source"), share("own").alias("share")), F.struct(F.lit("augmented").alias("source"), F.when(F.col("augmented").isNotNull(), share("augmented")).alias("share")))
    return both.select("line", F.explode(marked).alias("x")).select("line", "x.source", "x.share").where(F.col("share") >= overlap)


def thin_groups(rows: DataFrame, min_per_group: int) -> DataFrame:
    return rows.groupBy(F.coalesce("server", F.lit("?")).alias("grp")).agg(F.count("*").alias("n")).where(F.col("n") < min_per_group)


def same_family(generator: Column, augmenter: Column) -> Column:
    return tx.model_family(generator) == tx.model_family(augmenter)


def totals(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(what, value, n)``: kept, dropped and catalog sizes, kept rows by kind and by group."""
    dropped = F.lower(F.coalesce("status", F.lit("ok"))) == "dropped"
    kept = cases.where(~dropped)
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("value"), "n")
    parts = [one(kept, "kept"), one(cases.where(dropped), "dropped"), one(catalog.select("name").distinct(), "catalog")]
    for what, c in (("kind", F.coalesce("kind", F.lit("direct"))), ("group", F.coalesce("server", F.lit("?")))):
        parts.append(kept.groupBy(c.alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_prime(n: int) -> int:
    """The smallest prime that is at least n and 2."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def number_of(key: Column) -> Column:
    """A number below 2^32 that is fixed by a text."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def random_subset(cases: DataFrame, catalog: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``(query_id, name, pos)``: for each case its expected rows and others, n in all, in a shuffled order that is fixed by
    seed, case and n. A catalog of no more than n rows is shown whole, in the order of names; expected rows beyond n are kept.

    Others are drawn by place: with the catalog in the order of names, p the next prime from its size, and a start and a step
    that md5 fixes for each case, the places are (start + j * step) mod p for j = 0, 1, ... That visits every place once, any
    two names fall together as often as any two others, and a case costs as many rows as it shows, whatever the catalog holds.
    Names in ``catalog`` are unique and not null; null or empty ``expected`` and unknown names count for nothing.
    """
    names = numbered(catalog.select("name").where("name is not null"), "name", name="place")
    total = names.count()
    if total == 0:
        return cases.select("query_id", F.lit("").alias("name"), F.lit(0).alias("pos")).limit(0)
    prime = next_prime(total)
    wanted = F.array_compact(F.array_distinct(F.coalesce("expected", F.array().cast("array<string>"))))
    expected = cases.select("query_id", F.explode(wanted).alias("name")).join(names.select("name"), "name", "left_semi").select("query_id", "name")
    key = F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.lit(str(n)))
    walk = cases.select("query_id", wanted.alias("expected"), F.pmod(number_of(F.concat(F.lit("start:"), key)), F.lit(prime)).alias("start"), (F.pmod(number_of(F.concat(F.lit("step:"), key)), F.lit(prime - 1)) + 1).alias("step"))
    if total <= n:
        places = F.sequence(F.lit(0).cast("bigint"), F.lit(total - 1).cast("bigint"))
        shown = walk.select("query_id", F.explode(places).alias("place")).join(names, "place")
        return shown.select("query_id", "name", (F.col("place") + 1).cast("int").alias("pos"))
    # as many steps as there are rows to show, expected ones to pass over, and places beyond the catalog
    steps = F.least(F.lit(prime - 1), F.lit(n + prime - total - 1) + F.size("expected"))
    seen = walk.select("query_id", "expected", F.posexplode(F.transform(F.sequence(F.lit(0), steps), lambda j: F.pmod(F.col("start") + j * F.col("step"), F.lit(prime)))).alias("j", "place"))
    drawn = seen.where(F.col("place") < total).join(names, "place").where(~F.array_contains("expected", F.col("name")))
    have = expected.groupBy("query_id").agg(F.count("*").alias("have"))
    drawn = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("j"))).join(have, "query_id", "left")
    both = expected.unionByName(drawn.where(F.col("rn") <= n - F.coalesce("have", F.lit(0))).select("query_id", "name"))
    order = F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), F.col("query_id").cast("string"), F.col("name")))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "name")))


def shuffled(found: DataFrame, seed: int = 7) -> DataFrame:
    """A shortlist in an order fixed by seed and query instead of best first: adds ``pos``."""
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(draw(seed, F.col("query_id"), F.lit("shuffle"), F.col("id")), "id")))


def parse_condition(spec: str) -> tuple[str, str]:
    """``kind@argument``: all@N, all@all, or a shortlist kind with its size."""
    kind, _, arg = spec.partition("@")
    if kind not in ("all", "short", "short_aug", "short_shuffled", "short_aug_shuffled") or not arg:
        raise ValueError(f"bad condition {spec!r}")
    return kind, arg


def catalog_size(condition: Column, total: Column) -> Column:
    """How many rows a condition shows: null for shortlists, all for ``all``, else the smaller of the number and all."""
    n = F.regexp_extract(condition, r"^all-(\d+)$", 1)
    return F.when(condition == "all", total).when(n != "", F.least(n.cast("bigint"), total))


def projected_cost(jobs: DataFrame, cache: DataFrame, input_price: float, output_price: float, output_tokens: int = 250) -> DataFrame:
    """``(n_jobs, n_cached, input_tokens, usd)``: what running ``jobs(k, prompt)`` would cost beyond what is cached."""
    keys = cache.select("k").distinct().withColumn("hit", F.lit(True))
    marked = jobs.dropDuplicates(["k"]).join(keys, "k", "left")
    miss = F.col("hit").isNull()
    tokens = F.sum(F.when(miss, F.length("prompt")).otherwise(0)) / 4
    return marked.agg(
        F.count("*").alias("n_jobs"), F.count("hit").alias("n_cached"), F.floor(tokens).alias("input_tokens"), ((tokens * input_price + F.sum(miss.cast("bigint")) * output_tokens * output_price) / 1e6).alias("usd")
    )


def require_paid(jobs: DataFrame, cache: DataFrame, confirmed: bool) -> int:
    """The number of paid calls to make; stops (exit code 2) if there are any and nobody confirmed them."""
    n = jobs.dropDuplicates(["k"]).join(cache.select("k"), "k", "left_anti").count()
    if n and not confirmed:
        raise SystemExit(2)
    return n
