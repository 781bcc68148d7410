"""Filling containers of fixed capacity with texts that belong together.

Documents are encoded once. Those that speak of the same things come into one shard: a document's key is its term of largest
BM25 weight among those that many documents have, its second key the next such term. Small keys share a shard, large ones are
cut by second key, and what is still too large by id, into shards of about ``SHARD_DOCS``. A shard holds an inverted BM25
index of its documents (terms are token ids; frequencies, lengths and their averages are those of the whole corpus). The
largest unused document seeds a container; the index ranks the unused documents of the shard that share a term with it and
fit, and down this ranking they go in; what room is left is closed by the largest unused document that fits. Only documents
longer than the capacity are split: into full containers and a rest that is packed like a document. In the end the containers
of a shard that are still open are merged across ``MERGE_SHARDS`` shards, best fit first.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokenizer import bpe_of, read_ranks
from siftline.session import materialise, spread

SHARD_DOCS = 2048
SLOTS = 64
MERGE_SHARDS = 64
MAX_SPECS = 10_000
DENSE_SHARE = 8
FIRST_RANKS = 48
K1, B = 1.5, 0.75

_ENCODED = "id long, n_tokens long, terms array<int>, counts array<int>"


def encoded(docs: DataFrame, id_col: str, text_col: str, ranks) -> DataFrame:
    """``(id, n_tokens, terms, counts)``: a document's length, its different tokens in order and how often each stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                part = whole.slice(start, 1024)
                sizes, terms, counts, ends = [], [], [], [0]
                for text in part.column(1).to_pylist():
                    ids = np.frombuffer(bpe.encode_packed(text), np.int32)
                    term, n = np.unique(ids, return_counts=True)
                    sizes.append(len(ids))
                    terms.append(term)
                    counts.append(n)
                    ends.append(ends[-1] + len(term))
                offsets = pa.array(np.array(ends, np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32))) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n_tokens", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _ENCODED)


def corpus_statistics(docs: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, mean length, and document frequency of every token (as many rows as the vocabulary has) of ``encoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            found = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(df))
            found[: len(df)] += df
            df, n, length = found, n + batch.num_rows, length + int(batch.column("n_tokens").to_numpy().sum())
        at = np.flatnonzero(df)
        terms, counts = np.concatenate([at, [-1, -2]]), np.concatenate([df[at], [n, length]])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(counts, pa.int64())], ["term", "n"])

    rows = docs.select("n_tokens", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(rows.term, rows.n))
    n, length = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return int(n), float(length) / max(1, int(n)) or 1.0, df


def _flat(batch, name: str) -> np.ndarray:
    lists = batch.column(name)
    return (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False)


def _ends(batch) -> np.ndarray:
    lists = batch.column("terms")
    offsets = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).offsets.to_numpy()
    return offsets - offsets[0]


def weights_of(terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, stats: tuple[int, float, np.ndarray]) -> np.ndarray:
    """BM25 weight of each term of each document."""
    n_docs, mean, df = stats
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    length = np.repeat((K1 * (1 - B + B * sizes / mean)).astype(np.float32), np.diff(ends))
    return idf[terms] * counts * np.float32(K1 + 1) / (counts + length)


def keys_of(batch, stats: tuple[int, float, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A document's key, or -1, and the slot of its second key."""
    terms, counts, ends = _flat(batch, "terms"), _flat(batch, "counts"), _ends(batch)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    weights = weights_of(terms, counts, ends, batch.column("n_tokens").to_numpy(), stats)
    # terms that fill a shard or more (a fifth of the documents, if these are few), but not those of every third document
    n_docs, _, df = stats
    common = (df[terms] >= min(SHARD_DOCS, n_docs // 5)) & (3 * df[terms] <= n_docs)
    terms, owner, weights = terms[common], owner[common], weights[common].copy()
    keys = []
    for _ in range(2):
        key = np.full(batch.num_rows, -1, np.int64)
        if len(terms):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            most = np.repeat(np.maximum.reduceat(weights, begin), np.diff(np.append(begin, len(owner))))
            top = np.flatnonzero((weights == most) & (weights > 0))
            top = top[np.unique(owner[top], return_index=True)[1]]  # of equal ones the smallest term
            key[owner[top]] = terms[top]
            weights[top] = 0
        keys.append(key)
    first, second = keys
    return first, (second + 1) * 40_503 % 65_536 * SLOTS // 65_536


def lay_out(keys: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (key, slot), in order, its first shard and the number of shards that share it.

    Keys side by side fill a shard to ``SHARD_DOCS``; of a key larger than that, slots do; a slot larger than that has several shards.
    """
    order = np.lexsort((slots, keys))
    keys, slots, counts = keys[order], slots[order], counts[order]
    total: dict[int, int] = {}
    for k, n in zip(keys.tolist(), counts.tolist()):
        total[k] = total.get(k, 0) + n
    shard, held, first, parts, last = 0, 0, [], [], None
    for k, n in zip(keys.tolist(), counts.tolist()):
        whole = total[k] if k != last and total[k] <= SHARD_DOCS else n
        if held and (k != last or total[k] > SHARD_DOCS) and held + whole > SHARD_DOCS:
            shard, held = shard + 1, 0
        p = -(-n // SHARD_DOCS)
        first.append(shard)
        parts.append(p)
        held += n
        if p > 1:
            shard, held = shard + p, 0
        last = k
    return keys * SLOTS + slots, np.array(first, np.int64), np.array(parts, np.int64)


class Index:
    """Inverted BM25 index of one shard. Terms that one document in ``DENSE_SHARE`` has are rows of a matrix."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.n = len(offsets) - 1
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = owner[order], weights[order]
        unique, first, at = np.unique(terms[order], return_index=True, return_inverse=True)
        self.bounds = np.append(first, len(order))
        self.offsets, self.terms = offsets, np.empty(len(terms), np.int64)
        self.terms[order] = at
        common = np.flatnonzero(np.diff(self.bounds) * DENSE_SHARE >= self.n)
        row = np.full(len(unique), -1, np.int32)
        row[common] = np.arange(len(common))
        dense = np.zeros((len(common), self.n), np.float32)
        for k, t in enumerate(common):
            i, j = self.bounds[t], self.bounds[t + 1]
            dense[k, self.docs[i:j]] = self.weights[i:j]
        self.is_rare = row[self.terms] < 0
        # what the terms of the matrix give, for all documents at once
        self._scores = (dense > 0).T.astype(np.float32) @ dense
        self._whole = np.zeros(self.n, bool)

    def scores(self, doc: int) -> np.ndarray:
        """The score of every document for the terms of ``doc``; 0 where they share none, and for itself."""
        score = self._scores[doc]
        if not self._whole[doc]:
            at = slice(self.offsets[doc], self.offsets[doc + 1])
            rare = self.terms[at][self.is_rare[at]]
            begin, n = self.bounds[rare], self.bounds[rare + 1] - self.bounds[rare]
            posting = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            score += np.bincount(self.docs[posting], self.weights[posting], self.n)
            np.round(score, 4, out=score)
            score[doc] = 0
            self._whole[doc] = True
        return score

    def neighbours(self, doc: int, free: np.ndarray | None = None) -> Iterator[int]:
        """The documents that share a term with ``doc``, of those that are ``free``, best first; ties by number."""
        score = self.scores(doc)
        some = np.flatnonzero(score > 0 if free is None else (score > 0) & free)
        s = score[some]
        if len(some) > 2 * FIRST_RANKS:
            least = np.partition(s, -FIRST_RANKS)[-FIRST_RANKS]
            top = s >= least
            for part in (top, ~top):
                yield from some[part][np.argsort(-s[part], kind="stable")].tolist()
        else:
            yield from some[np.argsort(-s, kind="stable")].tolist()


def fill(sizes: Sequence[int], capacity: int, neighbours) -> list[list[int]]:
    """Containers (lists of item numbers) for items of 1 to ``capacity``.

    ``neighbours(i, free)`` names items to try first; ``free`` marks those that are unused and fit.
    """
    size = np.array(sizes, np.int64)
    order = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: (sizes[i], -i))
    ascending = [sizes[i] for i in order]
    rank = {i: r for r, i in enumerate(order)}
    below = list(range(-1, len(order)))  # below[r + 1]: the nearest unused rank at or under r

    def find(r: int) -> int:
        k = r + 1
        path = []
        while below[k] != k - 1:
            path.append(k)
            k = below[k] + 1
        for p in path:
            below[p] = k - 1
        return k - 1

    used = [False] * len(sizes)
    unused = size > 0

    def take(i: int) -> None:
        used[i] = True
        unused[i] = False
        r = rank[i]
        below[r + 1] = r - 1

    out = []
    for seed in reversed(order):
        if used[seed]:
            continue
        take(seed)
        box, room = [seed], capacity - sizes[seed]
        if room and find(bisect_right(ascending, room) - 1) >= 0:
            for j in neighbours(seed, unused & (size <= room)):
                if sizes[j] <= room and not used[j]:
                    take(j)
                    box.append(j)
                    room -= sizes[j]
                    if find(bisect_right(ascending, room) - 1) < 0:  # nothing that is left fits
                        break
        while room:
            r = find(bisect_right(ascending, room) - 1)
            if r < 0:
                break
            j = order[r]
            take(j)
            box.append(j)
            room -= sizes[j]
        out.append(box)
    return out


def read_specs(specs: DataFrame) -> list[tuple[int, int]]:
    """``(spec_id, capacity_tokens)`` of a small list; more than MAX_SPECS rows are an error."""
    rows = specs.select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities")
    return [(r.spec_id, r.capacity_tokens) for r in rows]


def pack(docs: DataFrame, id_col: str, text_col: str, specs: Sequence[tuple[int, int]], tokenizer: str | None = None) -> DataFrame:
    """``(spec_id, capacity_tokens, container_id, id_col, part, start_token, n_tokens)``: one row per document or part of one.

    ``specs`` are pairs of id and capacity. Ids must be unique integers. Documents of no tokens (null and empty texts)
    take no room: they lie in the first container of their shard. Each capacity gets all documents.
    """
    spark = docs.sparkSession
    if any(c is None or c < 1 for _, c in specs):
        raise ValueError("a capacity must be positive")
    ranks = spark.sparkContext.broadcast(read_ranks(tokenizer))
    docs = materialise(encoded(spread(docs.select(id_col, text_col)), id_col, text_col, ranks), "encoded")
    shared = spark.sparkContext.broadcast(corpus_statistics(docs))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, slot = keys_of(batch, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(slot, pa.int32())], ["key", "slot"])

    # no more rows than the vocabulary has entries, times SLOTS
    held = docs.mapInArrow(keyed, "key long, slot int").groupBy("key", "slot").agg(F.count("*").alias("n")).toArrow()
    layout = spark.sparkContext.broadcast(lay_out(*(held.column(c).to_numpy() for c in ("key", "slot", "n"))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, first, parts = layout.value
        for batch in batches:
            key, slot = keys_of(batch, shared.value)
            at = np.searchsorted(codes, key * SLOTS + slot)
            shard = first[at] + batch.column("spread").to_numpy() % parts[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_tokens", "terms", "counts")), pa.array(shard)], ["id", "n_tokens", "terms", "counts", "shard"])

    shards = docs.withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).mapInArrow(place, _ENCODED + ", shard long")
    caps = [(int(i), int(c)) for i, c in specs]
    schema = "spec_id long, shard long, box long, open boolean, id long, part int, start_token long, n_tokens long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = table.column("id").to_numpy()
        n_tokens = table.column("n_tokens").to_pylist()
        shard = table.column("shard")[0].as_py()
        terms, counts, ends = _flat(table, "terms"), _flat(table, "counts"), _ends(table)
        index = Index(ends, terms, weights_of(terms, counts, ends, np.array(n_tokens, np.int64), shared.value))
        out: list[list] = [[] for _ in names]

        def row(*values) -> None:
            for column, v in zip(out, values):
                column.append(v)

        for spec, cap in caps:
            box = 0
            sizes = []
            for i, n in enumerate(n_tokens):
                whole = n // cap if n > cap else 0
                for p in range(whole):
                    row(spec, shard, box, False, ids[i], p, p * cap, cap)
                    box += 1
                sizes.append(n - whole * cap)
            nothing = [i for i, n in enumerate(n_tokens) if n == 0]
            boxes = fill(sizes, cap, index.neighbours) or [[]] * bool(nothing and not box)
            for k, items in enumerate(boxes):
                left = cap - sum(sizes[i] for i in items)
                for i in items + (nothing if k == 0 else []):
                    start = n_tokens[i] - sizes[i]
                    row(spec, shard, box, left > 0, ids[i], start // cap if start else 0, start, sizes[i])
                box += 1
            if not boxes:
                for i in nothing:
                    row(spec, shard, 0, False, ids[i], 0, 0, 0)
        return pa.table([pa.array(c) for c in out], names=names).cast(pa.schema([("spec_id", pa.int64()), ("shard", pa.int64()), ("box", pa.int64()), ("open", pa.bool_()), ("id", pa.int64()), ("part", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64())]))

    packed = materialise(shards.groupBy("shard").applyInArrow(run, schema), "packed")
    capacity = {i: c for i, c in caps}
    open_boxes = packed.where("open").groupBy("spec_id", "shard", "box").agg(F.sum("n_tokens").alias("size"))

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("shard", "ascending"), ("box", "ascending")])
        spec = table.column("spec_id")[0].as_py()
        shard, box, size = (table.column(c).to_pylist() for c in ("shard", "box", "size"))
        rows = [(spec, shard[i], box[i], shard[g[0]], box[g[0]]) for g in fill([max(1, s) for s in size], capacity[spec], lambda *_: ()) for i in g]
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["spec_id", "shard", "box", "to_shard", "to_box"])

    moved = (
        open_boxes.withColumn("group", F.floor(F.col("shard") / MERGE_SHARDS))
        .groupBy("spec_id", "group")
        .applyInArrow(merge, "spec_id long, shard long, box long, to_shard long, to_box long")
        .where("shard <> to_shard or box <> to_box")
    )
    joined = packed.join(moved, ["spec_id", "shard", "box"], "left")
    by_spec = F.create_map(*[F.lit(x) for pair in caps for x in pair]) if caps else F.lit(None).cast("map<bigint,int>")
    return joined.select(
        "spec_id",
        by_spec[F.col("spec_id")].cast("int").alias("capacity_tokens"),
        (F.coalesce("to_shard", "shard") * F.lit(1 << 32) + F.coalesce("to_box", "box")).alias("container_id"),
        F.col("id").alias(id_col),
        "part",
        "start_token",
        "n_tokens",
    )
