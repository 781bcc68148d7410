"""Token totals by slice, counted once per distinct word.

Each partition counts its words by slice; the counts meet once per slice and word, where the word's symbols are merged in a
linked list by the priority queue of the tokenizer and the surviving symbols are counted; these are weighted by the word's
frequency and summed. The totals equal those of encoding every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokenizer import LONG_WORD, bpe_of, read_ranks
from siftline.session import spread

FLUSH_ENTRIES = 200_000


def token_totals(df: DataFrame, slice_cols: Sequence[str], text_cols: Sequence[str], tokenizer: str | None = None) -> DataFrame:
    """``(slice_cols..., field, n_texts, n_chars, n_tokens)``; n_texts counts texts that are neither null nor empty.

    A slice value may be null; slice columns are read as strings. Rows repeat as often as they stand in ``df``.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))
    n_slices, fields = len(slice_cols), list(text_cols)
    source = spread(df.select(*[F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(slice_cols)], *[F.col(c).alias(f"t{i}") for i, c in enumerate(fields)]))
    keys = [f"s{i}" for i in range(n_slices)] + ["field"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks.value)
        counts: dict[tuple, Counter] = {}
        sums: dict[tuple, list[int]] = {}
        entries = 0

        def rows() -> pa.RecordBatch:
            """Words with their counts; the totals of texts and characters stand in rows whose word is null."""
            out = [(k, w, n, 0, 0) for k, c in counts.items() for w, n in c.items()] + [(k, None, 0, *v) for k, v in sums.items()]
            columns = [pa.array([k[0][i] for k in out], pa.string()) for i in range(n_slices)] + [pa.array([fields[k[0][-1]] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string())]
            return pa.RecordBatch.from_arrays(columns + [pa.array([k[i] for k in out], pa.int64()) for i in (2, 3, 4)], [*keys, "word", "n", "n_texts", "n_chars"])

        for batch in batches:
            slices = list(zip(*[batch.column(i).to_pylist() for i in range(n_slices)])) if n_slices else [()] * batch.num_rows
            for f in range(len(fields)):
                for s, text in zip(slices, batch.column(n_slices + f).to_pylist()):
                    if not text:
                        continue
                    c, total = counts.setdefault((*s, f), Counter()), sums.setdefault((*s, f), [0, 0])
                    before = len(c)
                    words = bpe.words(text)
                    if len(max(words, key=len)) > LONG_WORD:
                        words = [p for w in words for p in ([w] if len(w) <= LONG_WORD else bpe._find(w))]
                    c.update(words)
                    total[0] += 1
                    total[1] += len(text)
                    entries += len(c) - before
            if entries > FLUSH_ENTRIES:
                yield rows()
                counts.clear()
                sums.clear()
                entries = 0
        yield rows()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks.value)
        sizes: dict[str | None, int] = {None: 0}
        for batch in batches:
            tokens = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                size = sizes.get(word)
                if size is None:
                    if len(sizes) > FLUSH_ENTRIES:
                        sizes = {None: 0}
                    size = sizes[word] = len(bpe.split_and_encode(word)) // 4
                tokens.append(size * n)
            columns = [*[batch.column(c) for c in [*keys, "n_texts", "n_chars"]], pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n_texts", "n_chars", "n_tokens"])

    head = "".join(f"{c} string, " for c in keys)
    partial = source.mapInArrow(count, head + "word string, n long, n_texts long, n_chars long")
    # added up before the shuffle; a word's counts go to as many tasks as it has slices, so no word is a hot key
    counted = partial.groupBy(*keys, "word").agg(*[F.sum(c).alias(c) for c in ("n", "n_texts", "n_chars")])
    weighed = counted.mapInArrow(weigh, head + "n_texts long, n_chars long, n_tokens long")
    out = weighed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_texts", "n_chars", "n_tokens")])
    return out.select(*[F.col(f"s{i}").alias(c) for i, c in enumerate(slice_cols)], "field", "n_texts", "n_chars", "n_tokens")


def text_tokens(df: DataFrame, id_col: str, text_cols: Sequence[str], tokenizer: str | None = None) -> DataFrame:
    """``(id_col, field, n_chars, n_tokens)``: one row per input row and text column, without a shuffle.

    Null and empty texts have no tokens; ``n_chars`` of a null text is null. Repeated rows keep their own rows.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))
    fields = list(text_cols)
    source = spread(df.select(df[id_col].alias("id"), *[df[c].alias(f"t{i}") for i, c in enumerate(fields)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks.value)
        for batch in batches:
            for i, field in enumerate(fields):
                texts = batch.column(i + 1).to_pylist()
                chars, tokens = pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([bpe.count(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([field] * len(texts), pa.string()), chars, tokens], ["id", "field", "n_chars", "n_tokens"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, field string, n_chars long, n_tokens long").withColumnRenamed("id", id_col)


def catalog_budget(catalog: DataFrame, servers: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Totals of ``description`` and ``parameters`` by server, language and domain, with all roll-ups.

    Servers are matched by their letters and digits; a row without one takes the part of its name before ``__``.
    Servers the list does not know keep their own key and get the domain ``unknown``; a null language is ``und``.
    A null in the result's ``server``, ``lang``, ``domain`` or ``field`` stands for all of them.
    """
    rows = catalog.select(
        F.coalesce(F.nullif(_key_of(F.col("metadata")["server"]), F.lit("")), _key_of(F.split_part(F.col("name"), F.lit("__"), F.lit(1))), F.lit("unknown")).alias("server_key"),
        F.coalesce(F.nullif(F.split_part(F.lower(F.trim("lang")), F.lit("-"), F.lit(1)), F.lit("")), F.lit("und")).alias("lang"),
        "description",
        "parameters",
    )
    totals = token_totals(rows, ["server_key", "lang"], ["description", "parameters"], tokenizer)
    known = (
        servers.select(_key_of(F.col("name")).alias("server_key"), F.lower(F.trim("name")).alias("server"), "category", "server_id")
        .where("server_key is not null and server_key <> ''")
        .groupBy("server_key")
        .agg(F.min_by("server", "server_id").alias("server"), F.min_by("category", F.when(F.col("category").isNotNull(), F.col("server_id"))).alias("domain"))
    )
    joined = totals.join(known, "server_key", "left").select(
        F.coalesce("server", "server_key").alias("server"), "lang", F.coalesce("domain", F.lit("unknown")).alias("domain"), "field", "n_texts", "n_chars", "n_tokens"
    )
    sets = [("server", "lang", "domain", "field"), ("server", "domain", "field"), ("server", "domain"), ("lang", "field"), ("domain", "field"), ("domain",), ("lang",), ("field",), ()]
    keys = ["server", "lang", "domain", "field"]
    grouped = joined.groupingSets([[F.col(c) for c in s] for s in sets], *keys)
    return grouped.agg(*[F.sum(c).alias(c) for c in ("n_texts", "n_chars", "n_tokens")])


def _key_of(column):
    return F.lower(F.regexp_replace(F.trim(column), r"[^\p{L}\p{N}]", ""))
