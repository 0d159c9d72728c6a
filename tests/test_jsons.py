import json

import pytest
from pyspark.sql import functions as F

from readsieve.functions import jsons

TEXT = (
    '{"foo": 123, "bar": [ 1, 2, { "baz": true } ], "h": "0x1F", "o": "017", "q": "a\\"b\\u0041", '
    '"n": null, "hx": "616263", "b6": "YWJj", "d": 1.5, "e": {}, "l": []}'
)


@pytest.fixture(scope="module")
def one(spark):
    def evaluate(column, text=TEXT):
        return spark.createDataFrame([(text,)], "j string").select(column.alias("x")).first().x

    return evaluate


def test_scan(spark):
    wanted = {
        "foo": (".foo", "%d"),
        "hex": (".h", "%d"),
        "octal": (".o", "%ld"),
        "q": (".q", "%Q"),
        "n": (".n", "%Q"),
        "hx": (".hx", "%H"),
        "b6": (".b6", "%V"),
        "d": (".d", "%f"),
        "baz": (".bar[2].baz", "%B"),
        "bar": (".bar", "%T"),
        "size": (".bar", lambda v: F.length(v)),
        "missing": (".zz", "%u"),
    }
    columns = jsons.scan(F.col("j"), wanted)
    row = spark.createDataFrame([(TEXT,)], "j string").select(*[c.alias(n) for n, c in columns.items()]).first()
    assert row.asDict() == {
        "foo": 123,
        "hex": 31,
        "octal": 15,
        "q": 'a"bA',
        "n": None,
        "hx": b"abc",
        "b6": b"abc",
        "d": 1.5,
        "baz": True,
        "bar": '[1,2,{"baz":true}]',
        "size": 18,
        "missing": None,
        "scanned": 10,
    }


@pytest.mark.parametrize(
    "text, value",
    [("12", 12), ("-0x10", -16), ("010", 8), ("+7", 7), ("0", 0), ("08", None), ("1.5", None), ("x", None), ("", None)],
)
def test_integers_of_any_base(one, text, value):
    assert one(jsons.base0_integer(F.col("j")), text) == value


def test_iterate(one):
    assert one(jsons.array_element(F.col("j"), ".bar", 2)) == '{"baz":true}'
    assert one(jsons.array_element(F.col("j"), ".bar", 3)) is None
    assert [tuple(e) for e in one(jsons.entries(F.col("j"), ".bar[2]"))] == [("baz", "true")]
    assert [tuple(e) for e in one(jsons.elements(F.col("j"), ".bar"))] == [(0, "1"), (1, "2"), (2, '{"baz":true}')]
    assert one(jsons.elements(F.col("j"), ".foo")) is None


def test_walk(one):
    text = '{ "foo": 123, "bar": [ 1, 2, { "baz": true } ] }'
    got = {tuple(n) for n in one(jsons.walk(F.col("j")), text)}
    assert got == {
        ("", None, "object", '{"bar":[1,2,{"baz":true}],"foo":123}'),
        (".foo", "foo", "number", "123"),
        (".bar", "bar", "array", '[1,2,{"baz":true}]'),
        (".bar[0]", "0", "number", "1"),
        (".bar[1]", "1", "number", "2"),
        (".bar[2]", "2", "object", '{"baz":true}'),
        (".bar[2].baz", "baz", "true", "true"),
    }
    assert one(jsons.walk(F.col("j")), "[1") is None
    assert [tuple(n) for n in one(jsons.walk(F.col("j")), "[]")] == [("", None, "array", "[]")]
    deep = "[" * 40 + '"]]]["' + "]" * 40
    nodes = one(jsons.walk(F.col("j")), deep)
    assert len(nodes) == 41 and nodes[-1]["path"] == "[0]" * 40 and nodes[-1]["value"] == '"]]]["'


@pytest.mark.parametrize(
    "path, value, wanted",
    [
        (".a", "7", '{"a":7,"b":[2]}'),
        (".b", "7", '{"a":1,"b":7}'),
        (".b[]", "7", '{"a":1,"b":[2,7]}'),
        (".b", None, '{"a":1}'),
        (".b[0]", '"x"', '{"a":1,"b":["x"]}'),
        (".b[0]", None, '{"a":1,"b":[]}'),
        (".c.d.e", "[1]", '{"a":1,"b":[2],"c":{"d":{"e":[1]}}}'),
        (".c", None, '{"a":1,"b":[2]}'),
        (".c.d", None, '{"a":1,"b":[2]}'),
    ],
)
def test_set(one, path, value, wanted):
    text = '{ "a": 1, "b": [ 2 ] }'
    assert one(jsons.set_path(F.col("j"), path, None if value is None else F.lit(value)), text) == wanted


def test_set_inside_an_outer_array(one):
    assert one(jsons.set_path(F.col("j"), "[1].x", F.lit("true")), '[1, {"y": 2}]') == '[1,{"x":true,"y":2}]'


def test_bad_paths():
    for path in ("a", ".a..b", ".a[x]"):
        with pytest.raises(ValueError):
            jsons.segments(path)


def test_prettify(one):
    assert one(jsons.prettify(F.col("j"))) == json.dumps(json.loads(TEXT), indent=2).replace('b\\u0041', "bA").replace(
        'a\\"bA', 'a\\"b\\u0041'
    )
    assert one(jsons.prettify(F.col("j")), "7") == "7"
    assert one(jsons.prettify(F.col("j")), '[ "a, b: {" ,2]') == '[\n  "a, b: {",\n  2\n]'


def test_escape_and_back(one):
    raw = 'a"b\\c\n\t\r\b\f\x01\x7fé'
    escaped = one(jsons.escape(F.col("j")), raw)
    assert escaped == 'a\\"b\\\\c\\n\\t\\r\\b\\f\\u0001\\u007fé'
    assert one(jsons.unescape(F.col("j")), escaped) == raw
    assert one(jsons.escape(F.col("j")), "\v") == "\\v"
    assert one(jsons.unescape(F.col("j")), "a\\/b") == "a/b"
    for bad in ("\\u1234", "\\q", "end\\"):
        assert one(jsons.unescape(F.col("j")), bad) is None


def test_print(one):
    assert one(jsons.hex_string(F.lit("abc"))) == '"616263"'
    assert one(jsons.base64_string(F.repeat(F.lit("a"), F.lit(90)).cast("binary"))) == '"' + "YWFh" * 30 + '"'
    assert one(jsons.quoted(F.lit('x"'))) == '"x\\""'
    assert one(jsons.quoted(F.lit(None).cast("string"))) == "null"
    assert one(jsons.print_object(a=F.lit(1), b=F.lit(None).cast("int"))) == '{"a":1,"b":null}'
    assert one(jsons.print_array(F.array(F.lit(1), F.lit(2)))) == "[1,2]"
