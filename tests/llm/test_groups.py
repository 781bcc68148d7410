import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import duplicates, neighbours, packing, spans

RECORDS = "tab string, rec_id bigint, field_name string, text string"


def brute_spans(rows, least):
    seen = {}
    for tab, i, _, t in rows:
        for p in range(len(t or "") - least + 1):
            seen.setdefault(t[p : p + least], set()).add((tab, i))
    out = set()
    for tab, i, f, t in rows:
        begin = None
        for p in range(len(t or "") - least + 1):
            if len(seen[t[p : p + least]]) > 1:
                if begin is None or p > end:
                    if begin is not None:
                        out.add((tab, i, f, begin, end))
                    begin = p
                end = p + least
        if begin is not None:
            out.add((tab, i, f, begin, end))
    return out


@pytest.mark.parametrize("group_blocks", [spans.GROUP_BLOCKS, 2])
def test_spans_are_those_of_brute_force(spark, monkeypatch, group_blocks):
    monkeypatch.setattr(spans, "GROUP_BLOCKS", group_blocks)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcé 日") for _ in range(n)) for n in (30, 60, 85, 120, 200, 79, 80, 81)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(pool)[rng.randint(0, 8) :] if rng.random() < 0.7 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5)))
        rows.append((rng.choice("ab"), i // 2, f"f{i % 2}", text))
    rows += [("a", 900, "f", None), ("a", 901, "f", ""), ("a", 902, "f", "aaaa" * 100), ("b", 902, "f", "aaaa" * 60), ("a", 903, "f", "twice " * 14), ("a", 903, "g", "twice " * 14)]
    rows += [("c", k, "f", pool[4]) for k in range(40)]
    df = spark.createDataFrame(rows, RECORDS).withColumn("key", F.lit("clash"))
    assert {tuple(r) for r in spans.shared_stretches(df).collect()} == brute_spans(rows, 80)


def test_spans_of_little(spark):
    none = spark.createDataFrame([], RECORDS)
    assert spans.shared_stretches(none).count() == 0
    assert spans.shared_stretches(spark.createDataFrame([("a", 1, "f", "x" * 79), ("a", 2, "f", "x" * 79)], RECORDS)).count() == 0
    long = "".join(random.Random(1).choices("abcdefgh ", k=300_000))
    got = {tuple(r) for r in spans.shared_stretches(spark.createDataFrame([("a", 1, "f", long), ("a", 2, "f", "--" + long[100:200] + "--")], RECORDS)).collect()}
    assert got == {("a", 1, "f", 100, 200), ("a", 2, "f", 2, 102)}


def test_a_passage_quoted_by_many_in_different_surroundings(spark, monkeypatch):
    """Every record has the passage between texts of its own: its first and last blocks differ in each of them."""
    monkeypatch.setattr(spans, "GROUP_BLOCKS", 20)
    rng = random.Random(9)
    word = lambda k: "".join(rng.choices("abcdefghij ", k=k))
    passage = word(150)
    rows = [("a", i, "f", word(60) + passage + word(60)) for i in range(60)] + [("b", i, "f", word(200)) for i in range(30)]
    assert {tuple(r) for r in spans.shared_stretches(spark.createDataFrame(rows, RECORDS)).collect()} == brute_spans(rows, 80)


def test_greedy_factors():
    a, b, c = "x" * 3 + "0123456789" * 2 + "y" * 3, "zz0123456789012345678", "45678901234yyy"
    blocks = [(a, 1, 1), (b, 2, 2), (c, 3, 3), (a[:12], 1, 1), ("q" * 12, 5, 9)]
    got = sorted(spans.factor(blocks, 10))
    windows = lambda k: {w for j, s, e in got if j == k for w in range(s, e + 1)}
    for k, (x, lo, hi) in enumerate(blocks[:4]):
        want = {w for w in range(len(x) - 9) if any(x[w : w + 10] in y and (l2, h2) != (lo, hi) for y, l2, h2 in blocks)}
        assert windows(k) == want
    assert spans.match("abcde", 1, "xbcdf", 1) == 3 and spans.match("ab", 0, "ab", 0) == 2 and spans.match("a", 0, "b", 0) == 0


def test_formatting_differences(spark):
    rows = [
        (1, "Pull 44, Badges!", ["a__b", "c"]), (2, "pull 44 badges", ["C", "A_B", "c"]), (3, "pull 44 badges", ["c"]), (4, "PULL\xad 44​badges", ["a__b", None, "c"]),
        (5, None, ["c"]), (6, " ?! ", ["c"]), (7, "x", None), (8, "X.", []), (9, "x", ["y"]), (7, "x", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, query string, expected array<string>, root string")
    marked = duplicates.with_digests(df, {"query": F.col("query"), "expected": F.col("expected")}, named=duplicates.has_query).withColumn("tab", F.lit("t"))
    assert sorted((r.keep_id, r.copy_id) for r in duplicates.copies(marked, ["tab"], "id").collect()) == [(1, 2), (1, 4), (7, 8)]
    assert sorted((r.keep_id, r.n_copies) for r in duplicates.groups(marked, ["tab"], "id").collect()) == [(1, 3), (3, 1), (7, 3), (9, 1)]
    assert duplicates.copies(marked.limit(0), ["tab"], "id").count() == 0


NESTED = "id int, r struct<name:string,tags:array<string>,steps:array<struct<do:string,n:int>>,meta:map<string,string>,inner:struct<x:double,y:array<array<string>>>>"


def test_nested_records_of_any_shape(spark):
    base = ("Ab c", ["x", "Y"], [("go", 1), ("stop", 2)], {"k": "V", "l": "W"}, (1.5, [["a", "b"], ["c"]]))
    same = ("aB-C!", ["y", "X", "x", None], [("GO", 1), ("s top", 2)], {"L": "w", "K": "v"}, (1.5, [["C"], ["B.", "a"]]))
    other = [
        ("Ab d", *base[1:]), (base[0], ["x"], *base[2:]), (*base[:2], [("stop", 2), ("go", 1)], *base[3:]), (*base[:2], [("go", 2), ("stop", 1)], *base[3:]),
        (*base[:3], {"k": "W", "l": "V"}, base[4]), (*base[:4], (2.5, base[4][1])), (*base[:4], (1.5, [["a"], ["b", "c"]])), (*base[:4], None), (None, *base[1:]), (base[0], None, *base[2:]),
    ]
    df = spark.createDataFrame([(1, base), (2, same), *((10 + i, o) for i, o in enumerate(other)), (30, None), (31, None), (40, (base[0], [], *base[2:]))], NESTED)
    marked = duplicates.with_digests(df, {"r": F.col("r")}, ordered=["r.steps"]).withColumn("tab", F.lit("t"))
    assert sorted((r.keep_id, r.copy_id) for r in duplicates.copies(marked, ["tab"], "id").collect()) == [(1, 2), (19, 40), (30, 31)]
    loose = duplicates.with_digests(df, {"r": F.col("r")}).withColumn("tab", F.lit("t"))
    assert (1, 12) in {(r.keep_id, r.copy_id) for r in duplicates.copies(loose, ["tab"], "id").collect()}  # steps in another order


def test_a_class_of_a_third_of_all_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "LEAST_HOT", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text = F.when(F.col("id") % 3 == 0, F.lit("the hot one")).otherwise(F.concat(F.lit("no "), (F.col("id") / 2).cast("int").cast("string")))
        df = spark.range(0, 30_000, 1, 12).withColumn("query", text).withColumn("tab", F.lit("t"))
        marked = duplicates.with_digests(df, {"query": F.col("query")})
        rows = duplicates.copies(marked, ["tab"], "id").withColumn("task", F.spark_partition_id()).collect()
        hot = [r for r in rows if r.keep_id == 0]
        assert len(hot) == 9_999 and len({r.copy_id for r in hot}) == 9_999
        tasks = {}
        for r in hot:
            tasks[r.task] = tasks.get(r.task, 0) + 1
        assert len(tasks) >= 6 and max(tasks.values()) < 5_000
        pairs = {}
        for i in range(30_000):
            if i % 3:
                pairs.setdefault(i // 2, []).append(i)
        assert {(r.keep_id, r.copy_id) for r in rows if r.keep_id} == {(min(v), x) for v in pairs.values() for x in v if x != min(v)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_case_lines(spark):
    rows = [(1, '{"query": "a", "expected": "x"}'), (2, '{"query":"A!","expected":["X"]}'), (3, '{"query": "a"'), (4, "[1]"), (5, None), (6, '{"query": 5, "expected": {"a": 1}}'), (7, ""), (8, '{"query":"b","expected":[1,null,"z"]}')]
    got = {r.line_id: (r.query, r.expected) for r in duplicates.parse_cases(spark.createDataFrame(rows, "line_id bigint, line string"), "line_id", "line").collect()}
    assert got == {1: ("a", ["x"]), 2: ("A!", ["X"]), 6: (None, []), 8: ("b", ["z"])}


def brute_neighbours(rows, k):
    out = set()
    for model in {m for _, m, _ in rows if m}:
        dim = int(model.split("-")[1])
        some = sorted((i, v) for i, m, v in rows if m == model and v and len(v) == dim and not any(x is None or x != x for x in v) and any(v))
        if not some:
            continue
        ids, x = np.array([i for i, _ in some]), np.array([v for _, v in some], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = np.round(x @ x.T, 6)
        for a in range(len(ids)):
            order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
            out |= {(int(ids[a]), int(i)) for _, i in order}
    return out


def vectors(n=700):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 8))
    rows = [(i, "m-8", [float(np.float32(x)) for x in centres[rng.integers(9)] + rng.normal(scale=0.3, size=8)]) for i in range(n)]
    rows += [(2000 + i, "m-8", rows[5][2]) for i in range(60)]  # equal vectors, more than any list needs
    rows += [(3000 + i, "m-3", [1.0, float(i), 0.0]) for i in range(5)]
    return rows + [(4000, "m-8", None), (4001, "m-8", [0.0] * 8), (4002, "m-8", [1.0] * 7), (4003, "m-8", [float("nan")] + [1.0] * 7), (4004, None, [1.0]), (4005, "m-8", [None] + [1.0] * 7)]


def test_neighbours_recall_and_exact_groups(spark, monkeypatch):
    # several leaves, bins, blocks of a bin, cells, query blocks and blocks of copies
    for name, n in {"LEAF_ROWS": 8, "BUCKET_ROWS": 16, "CELL_ROWS": 100, "QUERY_ROWS": 60, "COPY_ROWS": 7, "SAMPLE_ROWS": 400, "LEAST_SAMPLE": 20, "CHUNK_ROWS": 50, "FIRST_LEAVES": 2}.items():
        monkeypatch.setattr(neighbours, name, n)
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, model string, v array<float>, key string")
    got = {(r.id, r.neighbour) for r in neighbours.neighbours(df, "vec_id", "model", "v").collect()}
    want = brute_neighbours(rows, 10)
    assert len(got & want) >= 0.98 * len(want) and len(got) <= 1.01 * len(want)
    same = {i for i, m, v in rows if v == rows[5][2]}
    assert {p for p in got if p[0] in same} == {p for p in want if p[0] in same}
    assert {p for p in got if p[0] >= 3000} == {p for p in want if p[0] >= 3000}
    pairs = neighbours.mutual_pairs(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id bigint, neighbour bigint")).collect()
    assert {tuple(p) for p in pairs} == {(1, 2), (1, 3)} and len(pairs) == 2


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, model string, v array<float>")
    assert neighbours.neighbours(df, "vec_id", "model", "v").count() == 0
    one = spark.createDataFrame([(1, "m-2", [1.0, 0.0])], "vec_id bigint, model string, v array<float>")
    assert neighbours.neighbours(one, "vec_id", "model", "v").count() == 0
    bad = [float("nan"), float("inf"), None]
    odd = spark.createDataFrame([(i, "m-2", [1.0, x]) for i, x in enumerate(bad)] + [(7, "m-2", [0.0, -0.0]), (8, "m-2", [0.0, -1.0]), (None, "m-2", [1.0, 1.0]), (9, "m", [1.0, 1.0])], "vec_id bigint, model string, v array<float>")
    assert sorted(r.id for r in neighbours.usable(odd, "vec_id", "model", "v").collect()) == [8, 9]


def test_a_dense_group_larger_than_a_bin_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 16)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(neighbours, "LEAST_SAMPLE", 30)
    rng = np.random.default_rng(4)
    rows = [(i, "m-4", [1.0, 1.0, 1.0, float(np.float32(1 + rng.integers(0, 400) * 2e-7))]) for i in range(300)]
    rows += [(1000 + i, "m-4", rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    got = {(r.id, r.neighbour) for r in neighbours.neighbours(spark.createDataFrame(rows, "vec_id bigint, model string, v array<float>"), "vec_id", "model", "v").collect()}
    want = brute_neighbours(rows, 10)
    assert len(got & want) >= 0.97 * len(want) and len(got) <= 1.01 * len(want)


def test_search_pops_bins_by_bound_until_the_threshold():
    x = np.random.default_rng(0).normal(size=(400, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = neighbours.fit_tree(x, 20)
    n = len(tree.bins())
    assert all(sorted(found) == list(range(n)) for found in tree.search(x[:5], np.full(5, -9.0), 1.0))
    nearest = tree.nearest(x[:5]).tolist()
    assert all(b in found for b, found in zip(nearest, tree.search(x[:5], np.full(5, 0.9), 1.0)))
    centres, radius = tree.centres[tree.bins()], tree.radius[tree.bins()]
    for least in (0.2, 0.6, 0.9):
        for v, found in zip(x[:50], tree.search(x[:50], np.full(50, least), 1.5)):
            bound = centres @ v + 1.5 * radius
            assert all(bound[b] >= least - 1e-5 for b in found)


def test_leaves_cover_all_rows_and_equal_ones_stay_whole():
    x = np.random.default_rng(1).normal(size=(900, 6)).astype(np.float32)
    leaf = neighbours.leaves_of(x)
    assert len(leaf) == 900 and np.bincount(leaf).max() <= 4 * neighbours.LEAF_ROWS and len(set(leaf.tolist())) >= 900 // neighbours.LEAF_ROWS
    assert set(neighbours.leaves_of(np.ones((300, 3), np.float32)).tolist()) == {0}


def test_best_breaks_ties_by_id():
    rows, micro, ids = np.array([0, 0, 0, 0, 2]), np.array([5, 5, 4, 5, 1]), np.array([9, 8, 1, 2, 7])
    for n in (1, 3, 50):
        keep, ends = neighbours._best(rows, micro, ids, n, 3)
        assert ids[keep].tolist() == [2, 8, 9, 1][:n] + [7] and ends.tolist() == [0, min(n, 4), min(n, 4), min(n, 4) + 1]


def test_index_ranks_every_document_that_shares_a_term():
    rng = np.random.default_rng(3)
    docs = [np.sort(rng.choice(400, rng.integers(1, 90), replace=False)) for _ in range(200)] + [np.array([0, 1]) for _ in range(100)]
    weights = [(rng.integers(1, 60, len(d)) / 8).astype(np.float32) for d in docs]
    index = packing.Index(np.cumsum([0, *map(len, docs)]), np.concatenate(docs), np.concatenate(weights))
    for i in (0, 5, 150, 199, 250):
        score = {j: sum(w for t, w in zip(docs[j].tolist(), weights[j].tolist()) if t in set(docs[i].tolist())) for j in range(300) if j != i}
        assert list(index.neighbours(i)) == sorted((j for j in score if score[j] > 0), key=lambda j: (-score[j], j))


def test_late_seeds_of_a_large_group_still_get_their_own_kind():
    kind = [k % 2 for k in range(400)]
    index = packing.Index(np.arange(401), np.array(kind), np.ones(400, np.float32))
    boxes = packing.fill([10] * 400, 100, index.neighbours)
    assert len(boxes) == 40 and all(len({kind[i] for i in box}) == 1 for box in boxes)


def test_documents_of_one_subject_come_into_one_shard(spark, monkeypatch):
    """Eight subjects with words of their own: a document's nearest in the whole corpus lie in its shard, not one in many."""
    from siftline.llm.tokenizer import read_ranks

    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    rng = random.Random(3)
    words = [[f"{a}{b}ing" for b in "qw"] for a in ("mail", "rain", "bank", "song", "ship", "leaf", "code", "wolf")]
    docs = [(i, " ".join(rng.choices(words[i % 8], k=25) + rng.choices(["the", "of", "and"], k=25))) for i in range(480)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ranks = spark.sparkContext.broadcast(read_ranks())
    table = packing.encoded(df, "doc_id", "text", ranks)
    stats = packing.corpus_statistics(table)
    whole = table.toArrow().sort_by("id").combine_chunks()
    key, slot = packing.keys_of(whole, stats)
    pairs, n = np.unique(key * packing.SLOTS + slot, return_counts=True)
    codes, first, parts = packing.lay_out(pairs // packing.SLOTS, pairs % packing.SLOTS, n)
    shard = first[np.searchsorted(codes, key * packing.SLOTS + slot)]
    ends = packing._ends(whole)
    index = packing.Index(ends, packing._flat(whole, "terms"), packing.weights_of(packing._flat(whole, "terms"), packing._flat(whole, "counts"), ends, whole.column("n_tokens").to_numpy(), stats))
    near = [(i, j) for i in range(0, 480, 7) for j, _ in zip(index.neighbours(i), range(5))]
    assert sum(i % 8 == j % 8 for i, j in near) == len(near)
    assert sum(shard[i] == shard[j] for i, j in near) >= 0.3 * len(near) and len(set(shard.tolist())) >= 8
    assert all(len({int(s) for i, s in enumerate(shard) if i % 8 == kind}) <= 6 for kind in range(8))


def test_shards_hold_no_more_than_their_share(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    rng = np.random.default_rng(0)
    keys, slots = np.repeat(np.arange(-1, 30), 8), np.tile(np.arange(8), 31)
    counts = rng.integers(1, 40, len(keys))
    counts[80:88] = [90, 5, 700, 60, 50, 1, 1, 99]
    codes, first, parts = packing.lay_out(keys, slots, counts)
    held, of_key = {}, {}
    for code, f, p, n in zip(codes.tolist(), first.tolist(), parts.tolist(), counts.tolist()):
        for q in range(p):
            held[f + q] = held.get(f + q, 0) + n / p
            of_key.setdefault(code // packing.SLOTS, set()).add(f + q)
    assert max(held.values()) <= 100 and sum(held.values()) == counts.sum()
    total = {k: counts[keys == k].sum() for k in set(keys.tolist())}
    assert all(len(of_key[k]) == 1 for k in total if total[k] <= 100)
    assert packing.lay_out(*(np.zeros(0, np.int64) for _ in range(3)))[0].tolist() == []


def test_capacities_are_not_cut_off(spark, monkeypatch):
    specs = spark.createDataFrame([(i, 10 + i) for i in range(100)], "spec_id long, capacity_tokens int")
    assert packing.read_specs(specs) == [(i, 10 + i) for i in range(100)]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert {r.spec_id for r in packing.pack(docs, "doc_id", "text", packing.read_specs(specs)).collect()} == set(range(100))
    monkeypatch.setattr(packing, "MAX_SPECS", 99)
    try:
        packing.read_specs(specs)
        raise AssertionError("no error")
    except ValueError:
        pass
