import base64
import random

import pytest

from siftline.llm import budget, packing
from siftline.llm.encode import encode
from siftline.llm.tokenizer import PATTERN, Bpe, read_ranks, tokenizer_path

tiktoken = pytest.importorskip("tiktoken")
TEXTS = [None, "", " ", "\n", "Hello world", "  indented\n\n  code  \t x", "été ñ 日本語のテキスト 🚀", "a" * 3000, "it's they'LL 'quoted' don't", "x\x1c\x1dy \x85z w", " lead", "trail ", "1,000.50 €5"]


@pytest.fixture(scope="module")
def bpe():
    return Bpe(read_ranks())


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(), "rb"))}
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_another_implementation(bpe, other):
    rng = random.Random(3)
    letters = " \n\t a\x1c\x85\xa0'sé1²日 ll-Z."
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for t in texts:
        assert bpe.encode(t) == other.encode_ordinary(t), repr(t)
        assert bpe.decode(bpe.encode(t)) == t
        assert "".join(bpe.words(t)) == t
        assert sum(len(bpe.split_and_encode(w)) // 4 for w in bpe.words(t)) == bpe.count(t)


def test_caches_may_be_emptied(other, monkeypatch):
    from siftline.llm import tokenizer

    monkeypatch.setattr(tokenizer, "CACHE_ENTRIES", 3)
    small = Bpe(read_ranks())
    text = "one two three four five six one two " * 20
    assert small.encode(text) == other.encode_ordinary(text)


def test_column(spark, bpe):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(TEXTS)] + [(0, "again", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, id array<int>")
    got = [(r.doc_id, r.ids) for r in encode(df, "doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted([(i, bpe.encode(t)) for i, t, *_ in rows], key=repr)
    empty = encode(df.limit(0), "doc_id", "text")
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids"]


def test_token_totals_equal_encoding_every_text(spark, bpe):
    rows = [("a", "x", t, (t or "") + " more") for t in TEXTS] + [(None, "x", "Hello world", None)] * 3
    df = spark.createDataFrame(rows, "s string, field string, t string, u string")
    got = {(r.s, r.field): (r.n_texts, r.n_chars, r.n_tokens) for r in budget.token_totals(df, ["s"], ["t", "u"]).collect()}
    for s in ("a", None):
        for i, f in ((2, "t"), (3, "u")):
            texts = [r[i] for r in rows if r[0] == s and r[i]]
            if texts:
                assert got[(s, f)] == (len(texts), sum(map(len, texts)), sum(map(bpe.count, texts)))
    assert (None, "u") not in got
    assert budget.token_totals(df.limit(0), ["s"], ["t"]).count() == 0


def test_budget_of_odd_texts_and_of_each_text(spark, bpe):
    """A text of a zero byte is a text like others; every text's own count is that of its ids."""
    texts = ["\0", "x", "\0\0 a", None, "", "x", "word " * 3000, "q" * 500]
    df = spark.createDataFrame([(i, t, "t0") for i, t in enumerate(texts)], "id int, t string, t0 string")
    row = budget.token_totals(df, [], ["t"]).collect()[0]
    some = [t for t in texts if t]
    assert (row.n_texts, row.n_chars, row.n_tokens) == (len(some), sum(map(len, some)), sum(map(bpe.count, some)))
    got = {r.id: (r.n_chars, r.n_tokens) for r in budget.text_tokens(df, "id", ["t"]).collect()}
    assert got == {i: (None if t is None else len(t), len(bpe.encode(t))) for i, t in enumerate(texts)}
    assert budget.text_tokens(df.limit(0), "id", ["t", "t0"]).count() == 0


def test_budget_rolls_up_exactly(spark, bpe):
    tools = spark.createDataFrame(
        [("m__a", "one two", "{}", {"server": "Mail "}, "EN"), ("m__b", "three", None, {"server": "mail"}, "en-x"), ("odd__c", None, "[1]", None, None), ("q", "four", "", {}, "de")],
        "name string, description string, parameters string, metadata map<string,string>, lang string",
    )
    servers = spark.createDataFrame([(1, "mail", None), (2, "MAIL", "comms"), (3, " other", "dev"), (4, None, "x")], "server_id bigint, name string, category string")
    rows = budget.catalog_budget(tools, servers).collect()
    total = sum(bpe.count(x) for t in tools.collect() for x in (t.description, t.parameters))
    by = {(r.server, r.lang, r.domain, r.field): r.n_tokens for r in rows}
    assert by[(None, None, None, None)] == total
    assert by[("mail", None, "comms", None)] == bpe.count("one two") + bpe.count("{}") + bpe.count("three")
    assert by[("odd", "und", "unknown", "parameters")] == bpe.count("[1]") and ("q", "de", "unknown", "description") in by
    assert sum(v for (s, l, d, f), v in by.items() if None not in (s, l, d, f)) == total


def check_packing(rows, docs, specs, bpe):
    for spec, cap in specs:
        mine = [r for r in rows if r.spec_id == spec]
        parts, boxes = {}, {}
        for r in mine:
            parts.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
        assert max(boxes.values(), default=0) <= cap
        assert set(parts) == {i for i, _ in docs}
        for i, t in docs:
            n, got = bpe.count(t), sorted(parts[i])
            assert sum(x for _, x in got) == n
            assert len(got) == max(1, -(-n // cap)), "only what exceeds the capacity is split, into as few parts as possible"
            assert [s for s, _ in got] == [k * cap for k in range(len(got))]


def test_packing(spark, bpe, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    rng = random.Random(1)
    words = "mail send tool weather city rate query index token shard".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(500, None), (501, ""), (502, "long word " * 400), (503, "same"), (504, "same")]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id bigint, text string, shard int")
    specs = [(1, 64), (2, 256)]
    rows = packing.pack(df, "doc_id", "text", specs).collect()
    check_packing(rows, docs, specs, bpe)
    for spec, cap in specs:
        n = len({r.container_id for r in rows if r.spec_id == spec})
        assert n <= 1.06 * sum(bpe.count(t) for _, t in docs) / cap + 1
    assert packing.pack(df.limit(0), "doc_id", "text", specs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "text", [(1, 0)])


def test_fill_places_every_item_once_and_neighbours_first():
    sizes = [5, 5, 3, 3, 2, 0, 10]
    boxes = packing.fill(sizes, 10, lambda i, free: {6: [], 0: [2, 3], 1: []}.get(i, []))
    assert sorted(x for b in boxes for x in b) == [0, 1, 2, 3, 4, 6]
    assert all(sum(sizes[i] for i in b) <= 10 for b in boxes)
    assert [0, 2] == next(b for b in boxes if 0 in b)[:2]
    assert packing.fill([], 10, lambda i, free: []) == []


def test_index_scores_are_those_of_bm25_on_signatures():
    import numpy as np

    index = packing.Index(np.array([0, 2, 4, 4, 5]), np.array([7, 8, 8, 7, 9]), np.array([2.0, 1.0, 3.0, 0.5, 1.0]))
    assert [list(index.neighbours(i)) for i in (0, 2, 3)] == [[1], [], []]
    assert list(index.neighbours(0, np.array([True, False, True, True]))) == []


def test_vocabulary_is_read_from_a_parameter(tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)) + base64.b64encode(b"ab") + b" 256\n")
    assert Bpe(read_ranks(str(path))).encode("abab a") == [256, 256, 32, 97]
