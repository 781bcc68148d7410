import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1)
    for name, v in values.items():
        row = row.withColumn(name, v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string"))
    return row.select(column.alias("x")).first().x


def test_tokenisers_differ_on_digits_before_capitals(spark):
    assert one(spark, tx.tokenize("t"), t="getV2Api of the Mail_box") == ["get", "v2", "api", "mail", "box"]
    assert one(spark, tx.split_words("t"), t="getV2Api of the") == ["get", "v2api", "of", "the"]
    assert one(spark, tx.tokenize("t"), t=None) == []
    assert one(spark, tx.tokenize("t"), t="the of") == []


def test_hash_features(spark):
    got = one(spark, tx.hash_features(tx.split_words("t")), t="ab c")
    assert got == ["w:ab", "w:c", "b:ab_c", "c:#ab", "c:ab#", "c:#c#"]
    assert one(spark, tx.hash_features(tx.split_words("t")), t="") == []


def test_names(spark):
    assert one(spark, tx.humanise("t"), t="getHTTPData_v2-x.y") == "get httpdata v2 x y"
    assert one(spark, tx.clean_name(F.lit("x"), "t"), t="a.b c") == "x__a_b_c"
    assert len(one(spark, tx.clean_name(F.lit("x"), "t"), t="n" * 100)) == 64


def test_base_text_keeps_parameter_order_and_strips_trailing_colons(spark):
    schema = '{"properties":{"z":{"description":"last:"},"a":{"type":"string"}}}'
    df = spark.createDataFrame([("doIt", "About.", schema, ["t1", "t2"]), ("empty", "", "broken{", None)], "name string, description string, parameters string, tags array<string>")
    df = df.withColumn("params", tx.parameter_list("parameters"))
    rows = {r.name: r.t for r in df.select("name", tx.base_text("name", "description", "params", "tags").alias("t")).collect()}
    assert rows["doIt"] == "Tool: doIt (do it)\nAbout.\n- z: last\n- a\nTags: t1, t2"
    assert rows["empty"] == "Tool: empty (empty)"


def test_option_text_cuts_at_the_last_space(spark):
    params = F.array(F.struct(F.lit("a").alias("pname")), F.struct(F.lit("b").alias("pname")))
    none = F.slice(params, 1, 0)
    assert one(spark, tx.option_text("t", none, 12), t=" one two three ") == "one two..."
    assert one(spark, tx.option_text("t", params, 12), t="one\ntwo") == "one two (arguments: a, b)"
    assert one(spark, tx.option_text("t", none, 4), t="abcdefgh") == "abcd..."


def test_model_family(spark):
    for name, family in (("deepseek/deepseek-v4.1-flash", "deepseek"), ("claude-opus", "claude"), ("vendor/Qwen3-x", "qwen"), ("llm:deepseek/deepseek-v3:ab12", "deepseek"), ("4x", "4x")):
        assert one(spark, tx.model_family("t"), t=name) == family


def test_fences_and_estimates(spark):
    assert one(spark, tx.strip_fences("t"), t="```json\n{}\n``` ") == "{}"
    assert one(spark, tx.strip_fences("t"), t="{}") == "{}"
    assert one(spark, tx.token_estimate("t", "u"), t="abcde", u=None) == 1
    assert one(spark, tx.cache_key("t", "u"), t="a", u="b") == hashlib.sha256("a\x1fb".encode()).hexdigest()


def test_content_hash_ignores_key_order(spark):
    rows = [("n", "d", '{"a":1,"b":2}', ["t"]), ("n", "d", '{"b":2,"a":1}', ["t"])]
    got = [r.h for r in spark.createDataFrame(rows, "n string, d string, p string, t array<string>").select(tx.content_hash("n", "d", "p", "t").alias("h")).collect()]
    want = hashlib.sha256(json.dumps(["n", "d", {"a": 1, "b": 2}, ["t"]], sort_keys=True).encode()).hexdigest()[:16]
    assert got == [want, want]


def test_group_key(spark):
    df = spark.createDataFrame([({"server": "s"}, ["t"]), ({"server": ""}, ["t"]), (None, []), ({}, None)], "m map<string,string>, t array<string>")
    assert [r.g for r in df.select(tx.group_key("m", "t").alias("g")).collect()] == ["s", "t", "", ""]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 _é\n", max_size=12), min_size=1, max_size=8))
def test_tokenise_as_defined(spark, texts):
    import re

    def define(t):
        return [w for w in re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", t).lower()) if w not in tx.STOP_WORDS]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.tokenize("t").alias("x")).orderBy("i")
    assert [r.x for r in df.collect()] == [define(t) for t in texts]


def test_schemas_of_any_depth(spark):
    from siftline.sources.servers import clean_schema

    deep = '{"type":"object","properties":{"a":{"type":"string","items":' + "[" * 50_000 + "]" * 50_000 + '},"b":{"description":"x"}}}'
    row = spark.createDataFrame([(deep,)], "p string").select(tx.parameter_list("p").alias("params"), clean_schema("p").alias("clean")).first()
    assert [(p.pname, p.kind, p.description) for p in row.params] == [("a", "string", None), ("b", None, "x")] and row.clean == deep


def test_fences_and_white_space_of_any_script(spark):
    texts = ["\u3000```json\n {}\x0b```\u2028", "``` a```", "a ```", "```json", "\x1c x \x85", "", None, "``` ```", "x\n```\ny"]

    def plain(s):
        return None if s is None else re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", s.strip()))

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.strip_fences("t")).collect()]
    assert got == [plain(t) for t in texts]
