"""Places of JSON values and changes in place, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from readsieve.functions import json_spans, jsons

TEXT = ' {"b" : {"z":1, "a":[ 2,{"k":"é\\"}"} ,[]]}, "t":true,"n": null ,"e":{ } } '


@pytest.fixture(scope="module")
def one(spark):
    def evaluate(column, text):
        return spark.createDataFrame([(text,)], "j string").select(column.alias("x")).first().x

    return evaluate


def nodes(value, path="", name=None):
    """Every value with its path, inner ones first."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from nodes(v, f"{path}.{k}", k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from nodes(v, f"{path}[{i}]", str(i))
    yield path, name, value


def check(text, found):
    wanted = list(nodes(json.loads(text)))
    assert [(n.path, n.name) for n in found] == [(p, n) for p, n, _ in wanted]
    for n, (_, _, value) in zip(found, wanted):
        spelled = text[n.at : n.at + n.length]
        if n.type == "string":
            assert text[n.at - 1] == text[n.at + n.length] == '"'
            spelled = f'"{spelled}"'
        assert json.loads(spelled) == value and type(json.loads(spelled)) is type(value)


def test_spans(one):
    found = one(json_spans.spans(F.col("j")), TEXT)
    check(TEXT, found)
    assert found[-1].type == "object" and [n.type for n in found if n.path == ".b.a"] == ["array"]


def test_spans_in_bytes(one):
    text = '{"é":"ü","x":12}'
    found = one(json_spans.spans(F.col("j"), "bytes"), text)
    raw = text.encode()
    assert [raw[n.at : n.at + n.length].decode() for n in found] == ["ü", "12", text]


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice("abcdefgh") + str(i): made(rng, depth - 1) for i in range(rng.randint(0, 4))}
    if depth and kind < 0.7:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([0, -1.5, "x", "", 'q"[{', True, False, None])


def test_spans_of_random_values(spark):
    rng = random.Random(3)
    texts = [json.dumps(made(rng, 5), indent=rng.choice([None, 1])) for _ in range(60)]
    # more tokens than a piece
    texts.append(json.dumps([{"a": i, "b": [i]} for i in range(400)]))
    table = spark.createDataFrame([(t,) for t in texts], "j string")
    for row in table.select("j", json_spans.spans(F.col("j")).alias("s")).collect():
        check(row.j, row.s)


def test_what_is_no_json_is_null(spark):
    texts = [None, "", "  ", "{", "{a 1}", '{"a":0x1}', '{"a":1 "b":2}', '{"a":1,"a":2}', "[1,]", "abc"]
    table = spark.createDataFrame([(t,) for t in texts], "j string")
    got = table.select(json_spans.spans(F.col("j")).alias("a"), json_spans.splice(F.col("j"), ".a", F.lit("1")).alias("b"))
    assert all(r.a is None and r.b is None for r in got.collect())


SPLICED = [
    (".b.z", "7", TEXT.replace('"z":1', '"z":7')),
    (".b.a[1].k", "[]", TEXT.replace('"é\\"}"', "[]")),
    (".b.a[2]", '{"x": 1}', TEXT.replace("[]]", '{"x": 1}]')),
    (".b", "0", ' {"b" : 0, "t":true,"n": null ,"e":{ } } '),
    (".e.new", "1", TEXT.replace("{ }", '{"new":1 }')),
    (".b.y", "1", TEXT.replace("[]]}", '[]],"y":1}')),
    (".x.y.z", "1", TEXT.replace("{ } }", '{ },"x":{"y":{"z":1}} }')),
    (".l[]", "1", TEXT.replace("{ } }", '{ },"l":[1] }')),
    (".b.a[]", "3", TEXT.replace("[]]", "[],3]")),
    (".b.a[2][]", "3", TEXT.replace("[]]", "[3]]")),
    (".t.u", "3", TEXT.replace("true", '{"u":3}')),
    (".b.a[9]", "3", TEXT),
    (".t[0]", "3", TEXT),
    (".b.z", None, TEXT.replace('"z":1, ', " ")),
    (".b.a", None, TEXT.replace(', "a":[ 2,{"k":"é\\"}"} ,[]]', "")),
    (".b.a[0]", None, TEXT.replace(" 2,", " ")),
    (".b.a[1]", None, TEXT.replace(',{"k":"é\\"}"}', "")),
    (".b.a[1].k", None, TEXT.replace('"k":"é\\"}"', "")),
    (".none", None, TEXT),
]


def test_splice(one):
    columns = [json_spans.splice(F.col("j"), path, None if value is None else F.lit(value)) for path, value, _ in SPLICED]
    got = one(F.array(*columns), TEXT)
    assert got == [wanted for _, _, wanted in SPLICED]
    assert all(json.loads(g) for g in got)


def test_order_stays(one):
    text = '{"b":{"z":1,"a":2}}'
    assert one(json_spans.splice(F.col("j"), ".b.c", F.lit("3")), text) == '{"b":{"z":1,"a":2,"c":3}}'
    assert one(json_spans.splice(F.col("j"), ".b.c", F.lit("no json")), text) is None
    with pytest.raises(ValueError):
        json_spans.splice(F.col("j"), "", F.lit("3"))


def put(value, path, new):
    for part in path[:-1]:
        value = value[part]
    value[path[-1]] = new


def places(value, path=()):
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield (*path, k)
        yield from places(v, (*path, k))


def test_splice_at_every_place(spark):
    rng = random.Random(5)
    value = {"top": [made(rng, 4) for _ in range(4)], "o": made(rng, 4), "k": {"a": {"k": [1, {"k": 2}]}}}
    text = json.dumps(value)
    columns, wanted = [], []
    for place in rng.sample(list(places(value)), 6):
        path = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in place)
        changed = json.loads(text)
        put(changed, place, "new")
        columns.append(json_spans.splice(F.col("j"), path, F.lit('"new"')))
        wanted.append(json.dumps(changed))
    got = spark.createDataFrame([(text,)], "j string").select(F.array(*columns).alias("x")).first().x
    assert got == wanted


def test_bare_keys(one):
    text = '{a : 1, b_2:{"c": "x: {y:1}", d:[true,{e:null}]}}'
    quoted = '{"a" : 1, "b_2":{"c": "x: {y:1}", "d":[true,{"e":null}]}}'
    assert one(json_spans.quote_keys(F.col("j")), text) == quoted
    assert one(json_spans.quote_keys(F.col("j")), quoted) == quoted
    found = {n.path: text[n.at : n.at + n.length] for n in one(json_spans.spans(F.col("j")), text)}
    assert found[".b_2.c"] == "x: {y:1}" and found[".b_2.d[1].e"] == "null" and len(found) == 8
    assert one(json_spans.splice(F.col("j"), ".b_2.d[1].e", F.lit("5")), text) == text.replace("null", "5")
    assert one(jsons.token(json_spans.quote_keys(F.col("j")), ".b_2.d"), text) == '[true,{"e":null}]'
    wrong = ["{1a:1}", "{_a:1}", "{a:b}", "{a-b:1}", "{éa:1}"]
    assert one(F.array(*[json_spans.is_json(F.lit(w)) for w in wrong]), text) == [False] * len(wrong)


def test_long_strings(one):
    text = '{"a":"' + "x\\n" * 200_000 + '",b:1}'
    found = one(json_spans.spans(F.col("j")), text)
    assert [(n.path, n.length) for n in found] == [(".a", 600_000), (".b", 1), ("", len(text))]


def test_splice_by_keys_of_many_spellings(one):
    """Escaped keys, keys that only look alike, and NULL for what is no JSON, from the Arrow tasks too."""
    text = '{"a\\u0062":{"x":[1,{"k":"}]"}]}, "\\u4e00":2, "一😀":3}'
    assert one(json_spans.splice(F.col("j"), ".ab.x[1].k", F.lit("0")), text) == text.replace('"}]"', "0")
    assert one(json_spans.splice(F.col("j"), ".ab.x", None), text) == text.replace('"x":[1,{"k":"}]"}]', "")
    assert one(json_spans.splice(F.col("j"), ".ab.x[5]", F.lit("0")), text) == text
    assert one(json_spans.splice(F.col("j"), ".new", F.lit("0")), text) == text[:-1] + ',"new":0}'
    assert one(json_spans.splice(F.col("j"), ".a", F.lit("0")), '{"a":1') is None
    # no row-by-row folding over tokens in an expression is left
    shown = str(json_spans.splice(F.col("j"), ".a", F.lit("0")))
    assert "aggregate" not in shown
