"""Stretches of text that stand verbatim in another record: relative Lempel-Ziv parsing against indexed reference blocks.

Reference blocks: every text is cut where the smallest gram hash of a sliding window lies (winnowing), so two texts that
share a run of ``least`` characters share an anchor in it. The block of an anchor is the stretch covered by the windows
that chose it. Each different block is kept once, with the smallest and largest record that holds it. A block that two
records hold whole is a factor as it is. The others meet at their anchor.

Parse: the blocks of an anchor are each other's reference. Their windows are indexed by their characters, and each block is
factored greedily from left to right: at a position the index names a block of another record, the match is extended
character by character as far as it goes, and becomes a factor if it has ``least`` characters. Then the windows that straddle
the factor's end are looked up, as another reference may go on there. Factors of a text that touch or overlap are one
stretch, which may draw on several records.

An anchor may have many surroundings, such as the beginning of a passage that a third of all rows quote. Beyond
``GROUP_BLOCKS`` different blocks they don't meet in one task: each window is a row, and windows are grouped by two
independent 64-bit hashes, with partial aggregation. That finds the same windows.

Equal texts are parsed once. All groupings (same text, same block, same window) are pre-aggregated to their smallest and
largest record, so passages that stand in a third of all rows make no hot task and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import materialise

LEAST = 80
GRAM = 24
GROUP_BLOCKS = 5_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_CHUNK_CHARS = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Grams:
    """Hashes of any stretch of some texts laid end to end; the two bases give independent ones."""

    def __init__(self, texts: list[str], base: int = 0):
        self.base = np.uint64(_BASES[base])
        inverse = np.uint64(pow(_BASES[base], -1, 1 << 64))
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1] if texts else np.zeros(0, np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(codes)
        self.n = n
        with np.errstate(over="ignore"):
            # multiplied in turn by the base: position i has weight base^i; the inverse takes it back
            power = np.full(n + 1, self.base, np.uint64)
            back = np.full(n + 1, inverse, np.uint64)
            power[0] = back[0] = 1
            self.power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(back)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes + self.base) * self.power[:n], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * self.base)


def _leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each window of ``width``."""
    at, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        span += step
    return at


def blocks_of(texts: list[str], least: int, gram: int) -> tuple[Grams, tuple[np.ndarray, ...]]:
    """For each block: text number, anchor hash, anchor offset in the block, first window's start, number of windows, two block hashes.

    Window w of a block is the run of ``least`` characters that begins at the first window's start plus w.
    """
    g = Grams(texts)
    if g.n < least:
        return g, tuple(np.zeros(0, np.int64) for _ in range(7))
    starts = np.arange(g.n - gram + 1)
    anchor = _leftmost_minimum(g.hash(starts, starts + gram), least - gram + 1)  # of the window that begins at each position
    text = np.repeat(np.arange(len(texts)), g.lengths)[: len(anchor)]
    inside = np.arange(len(anchor)) + least <= (g.starts + g.lengths)[text]
    window = np.flatnonzero(inside)
    anchor, text = anchor[window], text[window]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(window) else np.zeros(0, np.int64)
    first = window[new]
    count = np.diff(np.append(new, len(window)))
    at = anchor[new]
    end = first + least - 1 + count
    return g, (text[new], g.hash(at, at + gram).view(np.int64), at - first, first, count, g.hash(first, end).view(np.int64), Grams(texts, 1).hash(first, end).view(np.int64))


def shared_stretches(records: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``(tab, rec_id, field_name, start_char, end_char)``: maximal stretches of shared characters of every field.

    ``records`` has ``tab, rec_id, field_name, text``; a record is a (tab, rec_id) and may have several fields. A
    character is shared if it lies in a run of ``least`` characters that stands in a field of another record; repeats
    inside one record do not count. Null texts and those shorter than ``least`` have no stretches. Positions count code
    points.
    """
    rows = records.where(F.length("text") >= least).withColumn("key", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.length("text").alias("n")))
    # records are told apart by a 64-bit hash, so that all groupings aggregate in fixed-width buffers
    rows = rows.withColumn("rec", F.xxhash64("tab", "rec_id"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.min("rec").alias("lo"), F.max("rec").alias("hi"))
    texts = materialise(texts.select("key", "text", "lo", "hi"), "texts")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").to_pylist()
            start = 0
            while start < len(column):
                stop, chars = start, 0
                while stop < len(column) and (stop == start or chars + len(column[stop]) <= _CHUNK_CHARS):
                    chars += len(column[stop])
                    stop += 1
                g, (text, anchor, offset, first, count, *whole) = blocks_of(column[start:stop], least, gram)
                take = pa.array(start + text)
                begin = first - g.starts[text] if len(text) else first
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(take), batch.column("lo").take(take), batch.column("hi").take(take),
                        pa.array(anchor, pa.int64()), pa.array(offset, pa.int32()), pa.array(begin, pa.int32()), pa.array(count, pa.int32()),
                        pa.StructArray.from_arrays([pa.array(h, pa.int64()) for h in whole], ["a", "b"]),
                    ],
                    ["key", "lo", "hi", "anchor", "at", "begin", "windows", "whole"],
                )
                start = stop

    key_type = "struct<a:bigint,b:int,n:int>"
    found = texts.mapInArrow(blocks, f"key {key_type}, lo long, hi long, anchor long, at int, begin int, windows int, whole struct<a:bigint,b:bigint>")
    found = materialise(found, "found")
    # the blocks of anchors that no other record holds end here; min and max are combined before the shuffle
    held = found.groupBy("anchor", "whole", "at", "windows").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.first(f"key.{c}").alias(f"one_{c}") for c in "abn"], F.first("begin").alias("one_begin"))
    held = materialise(held, "blocks")
    anchors = held.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("kinds")).where("lo <> hi")
    index = held.join(anchors.select("anchor", "kinds"), "anchor")
    key = F.struct(*[F.col(f"one_{c}").alias(c) for c in "abn"]).alias("key")
    mixed = index.where("kinds > 1").select(key, F.struct("anchor", "whole", F.col("one_begin").alias("begin"), "windows", "lo", "hi", (F.col("kinds") > GROUP_BLOCKS).alias("hot")).alias("p"))
    # each text's own blocks: no more than the text is long
    picked = mixed.groupBy("key").agg(F.collect_list("p").alias("picked")).join(texts.select("key", "text"), "key").select("text", "picked")
    # cold anchors have a row for each block, with its characters; hot ones a row for each window, with its hashes
    meeting = picked.mapInArrow(lambda batches: _meeting_rows(batches, least), _MEETING)
    meeting = materialise(meeting, "meeting")
    parsed = meeting.where("text is not null").select("anchor", "whole", "text", "lo", "hi").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _parse(batches, least), _FACTOR)
    factors = parsed.unionByName(_by_window(meeting.where("text is null").select("whole", "w", "hash", "lo", "hi")))
    factors = factors.unionByName(index.where("lo <> hi").select("whole", F.lit(0).alias("w0"), (F.col("windows") - 1).alias("w1")).distinct())
    spans = found.select("key", "whole", "begin").join(factors, "whole").select("key", (F.col("begin") + F.col("w0")).alias("s"), (F.col("begin") + F.col("w1") + least).alias("e"))
    # factors of one text that touch or overlap are one stretch
    w = Window.partitionBy("key").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    stretch = spans.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    stretch = stretch.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "no").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    out = rows.select("tab", "rec_id", "field_name", "key").join(stretch, "key")
    return out.select("tab", "rec_id", "field_name", F.col("s").cast("long").alias("start_char"), F.col("e").cast("long").alias("end_char"))


_MEETING = "anchor long, whole struct<a:bigint,b:bigint>, text string, w int, hash struct<a:bigint,b:bigint>, lo long, hi long"
_FACTOR = "whole struct<a:bigint,b:bigint>, w0 int, w1 int"
_PAIR = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _meeting_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "whole", "text", "w", "hash", "lo", "hi"]
    for batch in batches:
        lists = batch.column("picked")
        parts, texts = lists.flatten(), batch.column("text").to_pylist()
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        begin, windows = (parts.field(c).to_numpy() for c in ("begin", "windows"))
        hot = parts.field("hot").to_numpy(zero_copy_only=False)
        whole = [parts.field(c) for c in ("anchor", "whole", "lo", "hi")]
        cold = np.flatnonzero(~hot)
        for at in range(0, len(cold), 50_000):
            some = cold[at : at + 50_000]
            runs = [texts[t][i : i + n] for t, i, n in zip(owner[some].tolist(), begin[some].tolist(), (windows[some] - 1 + least).tolist())]
            anchor, block, lo, hi = (c.take(pa.array(some)) for c in whole)
            yield pa.RecordBatch.from_arrays([anchor, block, pa.array(runs, pa.string()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), _PAIR), lo, hi], names)
        for t in np.unique(owner[hot]):
            mine = ends[t] + np.flatnonzero(hot[ends[t] : ends[t + 1]])
            w = np.concatenate([np.arange(n) for n in windows[mine].tolist()])
            start = np.repeat(begin[mine], windows[mine]) + w
            hashes = [pa.array(Grams([texts[t]], base).hash(start, start + least).view(np.int64)) for base in (0, 1)]
            anchor, block, lo, hi = (c.take(pa.array(np.repeat(mine, windows[mine]))) for c in whole)
            yield pa.RecordBatch.from_arrays([anchor, block, pa.nulls(len(w), pa.string()), pa.array(w, pa.int32()), pa.StructArray.from_arrays(hashes, ["a", "b"]), lo, hi], names)


def match(x: str, i: int, y: str, j: int) -> int:
    """How many characters of x from i and of y from j on are the same."""
    n = min(len(x) - i, len(y) - j)
    if x[i : i + n] == y[j : j + n]:
        return n
    low, high = 0, n  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if x[i : i + mid] == y[j : j + mid]:
            low = mid
        else:
            high = mid
    return low


def factor(blocks: list[tuple[str, int, int]], least: int) -> Iterator[tuple[int, int, int]]:
    """``(block, first window, last window)`` of the factors of some blocks ``(text, lo, hi)`` against each other.

    A window of a block is shared if a block of another record has it. The index keeps for each window the first block that
    has it and the first of another record than that.
    """
    index: dict[str, tuple[int, int]] = {}
    others: dict[str, tuple[int, int]] = {}
    for k, (x, lo, hi) in enumerate(blocks):
        for w in range(len(x) - least + 1):
            run = x[w : w + least]
            at = index.setdefault(run, (k, w))
            if at[0] != k and run not in others and (blocks[at[0]][1] != lo or blocks[at[0]][2] != hi):
                others[run] = (k, w)
    for k, (x, lo, hi) in enumerate(blocks):
        if lo != hi:
            continue  # two records hold it whole
        w, last = 0, len(x) - least
        while w <= last:
            run = x[w : w + least]
            at = index[run]
            if blocks[at[0]][1:] == (lo, hi):
                at = others.get(run)
            if at is None:
                w += 1
                continue
            end = w + match(x, w, blocks[at[0]][0], at[1]) - least
            yield k, w, end
            w = end + 1  # the windows that straddle the factor's end come next


def _parse(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The factors of the blocks of each anchor; rows come sorted by anchor."""
    anchor, wholes, blocks = None, [], []
    out: list[tuple[int, int, int, int]] = []

    def close() -> None:
        out.extend((*wholes[k], a, b) for k, a, b in factor(blocks, least))
        wholes.clear()
        blocks.clear()

    def batch() -> pa.RecordBatch:
        a, b, w0, w1 = (np.array(c, np.int64) for c in (zip(*out) if out else [()] * 4))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), pa.array(w0.astype(np.int32)), pa.array(w1.astype(np.int32))], ["whole", "w0", "w1"])

    for part in batches:
        columns = [part.column("anchor"), part.column("whole").field("a"), part.column("whole").field("b"), *(part.column(c) for c in ("text", "lo", "hi"))]
        for x, a, b, *block in zip(*(c.to_pylist() for c in columns)):
            if x != anchor:
                close()
                anchor = x
            wholes.append((a, b))
            blocks.append(tuple(block))
        if len(out) > 50_000:
            yield batch()
    close()
    yield batch()


def _by_window(each: DataFrame) -> DataFrame:
    """The factors of the blocks of hot anchors from ``each(whole, w, hash, lo, hi)``, a row for each window."""
    common = each.groupBy("hash").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("hash")
    shared = each.where("lo = hi").join(common, "hash").select("whole", "w")
    run = shared.withColumn("g", F.col("w") - F.row_number().over(Window.partitionBy("whole").orderBy("w")))
    return run.groupBy("whole", "g").agg(F.min("w").alias("w0"), F.max("w").alias("w1")).select("whole", "w0", "w1")
