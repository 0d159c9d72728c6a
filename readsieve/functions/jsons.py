"""JSON columns: scan, walk, set, iterate, print.

Paths are written ``.a.b[2]``. Everything is a Catalyst expression. Values come
back as normalised JSON text (no spaces between tokens); ``set_path`` keeps the
key order of the outermost object, nested objects come back sorted by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"\.([^.\[\]]+)|\[(\d*)\]")


def segments(path: str) -> list[str | int | None]:
    """Path parts: a key, an array index, or None for the array's end ``[]``."""
    found, at = [], 0
    while at < len(path):
        m = _SEGMENT.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path {path!r}")
        found.append(m[1] if m[1] is not None else int(m[2]) if m[2] else None)
        at = m.end()
    return found


def _variant_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in segments(path))


def _at(text: Column, path: str) -> Column:
    return F.variant_get(F.try_parse_json(text), _variant_path(path), "variant")


# ----------------------------------------------------------------------- scan


def token(text: Column, path: str) -> Column:
    """The value at a path as JSON text; a missing path is NULL."""
    return F.to_json(_at(text, path))


def scalar(text: Column, path: str) -> Column:
    """The value at a path as plain text: strings unquoted, JSON null is NULL.

    Like every conversion it starts from the same parsed value, so that a plan
    with many of them parses each text once.
    """
    return F.try_variant_get(F.try_parse_json(text), _variant_path(path), "string")


def base0_integer(text: Column) -> Column:
    """Integer in decimal, 0x-hexadecimal or 0-octal notation; NULL otherwise."""
    sign = F.when(F.startswith(text, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(text, "^[+-]", "")
    value = (
        F.when(digits.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(digits, 3, 15), 16, 10).cast("long"))
        .when(digits.rlike("^0[0-7]{0,20}$"), F.conv(digits, 8, 10).cast("long"))
        .when(digits.rlike("^[1-9][0-9]*$"), digits.try_cast("long"))
    )
    return sign * value


_CONVERSIONS: dict[str, Callable[[Column, str], Column]] = {
    "%d": lambda t, p: base0_integer(scalar(t, p)).try_cast("int"),
    "%i": lambda t, p: base0_integer(scalar(t, p)).try_cast("int"),
    "%ld": lambda t, p: base0_integer(scalar(t, p)),
    "%u": lambda t, p: base0_integer(scalar(t, p)),
    "%lu": lambda t, p: base0_integer(scalar(t, p)),
    "%f": lambda t, p: scalar(t, p).try_cast("double"),
    "%lf": lambda t, p: scalar(t, p).try_cast("double"),
    "%B": lambda t, p: F.when(_at(t, p).isNotNull(), F.coalesce(token(t, p) == "true", F.lit(False))),
    "%Q": scalar,
    "%H": lambda t, p: F.unhex(scalar(t, p)),
    "%V": lambda t, p: F.unbase64(scalar(t, p)),
    "%T": token,
}


def scan(text: Column, wanted: dict[str, tuple[str, str | Callable[[Column], Column]]]) -> dict[str, Column]:
    """Columns by name from ``{name: (path, conversion)}``.

    A conversion is one of ``%d %i %u %ld %lu %f %lf %B %Q %H %V %T``, or a
    function of the value's JSON text. ``scanned`` counts the values found.
    """
    columns = {}
    for name, (path, how) in wanted.items():
        columns[name] = _CONVERSIONS[how](text, path) if isinstance(how, str) else how(token(text, path))
    found = [c.isNotNull().cast("int") for c in columns.values()]
    total = found[0]
    for one in found[1:]:
        total = total + one
    return {**columns, "scanned": total}


def array_element(text: Column, path: str, index: int) -> Column:
    """The index-th element of the array at a path, as JSON text."""
    return token(text, f"{path}[{index}]")


# -------------------------------------------------------------------- iterate


def entries(text: Column, path: str = "") -> Column:
    """Array of ``(key, value)`` of the object at a path, in the order of the text."""
    found = text if path == "" else F.get_json_object(text, _variant_path(path))
    held = F.map_entries(F.from_json(found, "map<string,variant>"))
    return F.transform(held, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))


def elements(text: Column, path: str = "") -> Column:
    """Array of ``(idx, value)`` of the array at a path."""
    held = F.try_variant_get(F.try_parse_json(text), _variant_path(path), "array<variant>")
    return F.transform(held, lambda v, i: F.struct(i.alias("idx"), F.to_json(v).alias("value")))


# ----------------------------------------------------------------------- walk


_NODES = "array<struct<path:string,name:string,text:string,value:variant>>"


def _node(path: Column, name: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), name.alias("name"), F.to_json(value).alias("text"), value.alias("value"))


def _children(node: Column) -> Column:
    start = F.left(node["text"], F.lit(1))
    keyed = F.transform(
        F.map_entries(F.try_variant_get(node["value"], "$", "map<string,variant>")),
        lambda e: _node(F.concat(node["path"], F.lit("."), e["key"]), e["key"], e["value"]),
    )
    indexed = F.transform(
        F.try_variant_get(node["value"], "$", "array<variant>"),
        lambda v, i: _node(F.concat(node["path"], F.lit("["), i.cast("string"), F.lit("]")), i.cast("string"), v),
    )
    return (
        F.when(start == "{", keyed.cast(_NODES))
        .when(start == "[", indexed.cast(_NODES))
        .otherwise(F.array().cast(_NODES))
    )


def _type(text: Column) -> Column:
    start = F.left(text, F.lit(1))
    return (
        F.when(start == "{", F.lit("object"))
        .when(start == "[", F.lit("array"))
        .when(start == '"', F.lit("string"))
        .when(start.isin("t", "f", "n"), text)
        .otherwise(F.lit("number"))
    )


def _most_levels(text: Column) -> Column:
    """No fewer than the levels of nesting: openings minus closings, at their highest.

    Brackets inside strings are taken out first.
    """
    bare = F.regexp_replace(text, r'"(?:\\.|[^"\\])*+"', "")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]", "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, d: F.struct((acc["now"] + d).alias("now"), F.greatest(acc["most"], acc["now"] + d).alias("most")),
        lambda acc: acc["most"],
    )


def walk(text: Column) -> Column:
    """Array of ``(path, name, type, value)`` for the value and all inside it.

    Goes level by level, to the depth of the row's own text.
    """
    top = F.array(_node(F.lit(""), F.lit(None).cast("string"), F.try_parse_json(text))).cast(_NODES)

    def listed(levels: Column) -> Column:
        return F.transform(
            F.flatten(levels),
            lambda n: F.struct(
                n["path"].alias("path"), n["name"].alias("name"), _type(n["text"]).alias("type"), n["text"].alias("value")
            ),
        )

    found = F.aggregate(
        F.sequence(F.lit(1), F.greatest(_most_levels(text), F.lit(1))),
        F.array(top).cast(f"array<{_NODES}>"),
        lambda levels, _: F.array_append(levels, F.flatten(F.transform(F.element_at(levels, -1), _children))),
        listed,
    )
    return F.when(F.try_parse_json(text).isNotNull(), found)


# ------------------------------------------------------------------------ set


_MAP = "map<string,variant>"
_ARRAY = "array<variant>"


def _with_value(value: Column, parts: list, new: Column | None) -> Column:
    """``value`` (a variant) with ``new`` put at ``parts``, or that place removed."""
    if not parts:
        return new
    head, rest = parts[0], parts[1:]
    if isinstance(head, str):
        held = F.coalesce(F.try_variant_get(value, "$", _MAP), F.create_map().cast(_MAP))
        others = F.map_filter(held, lambda k, _: k != head)
        if new is None and not rest:
            return F.to_variant_object(others)
        inner = _with_value(F.element_at(held, head), rest, new)
        changed = F.map_concat(others, F.create_map(F.lit(head), inner))
        if new is None:
            # nothing to remove below a key that is not there
            changed = F.when(F.map_contains_key(held, head), changed).otherwise(held)
        return F.to_variant_object(changed)
    held = F.coalesce(F.try_variant_get(value, "$", _ARRAY), F.array().cast(_ARRAY))
    if head is None:
        if new is None:
            return F.to_variant_object(held)
        return F.to_variant_object(F.array_append(held, _with_value(F.parse_json(F.lit("null")), rest, new)))
    if new is None and not rest:
        return F.to_variant_object(F.filter(held, lambda _, i: i != head))
    return F.to_variant_object(
        F.transform(held, lambda v, i: F.when(i == head, _with_value(v, rest, new)).otherwise(v))
    )


def _with_entry(held: Column, key: str, rest: list, new: Column | None) -> Column:
    """The outermost object: its keys stay where they are, a new key comes last."""
    if new is None and not rest:
        return F.map_filter(held, lambda k, _: k != key)
    inner = _with_value(F.element_at(held, key), rest, new)
    changed = F.transform_values(held, lambda k, v: F.when(k == key, inner).otherwise(v))
    if new is None:
        return changed
    added = F.map_concat(held, F.create_map(F.lit(key), inner))
    return F.when(F.map_contains_key(held, key), changed).otherwise(added)


def set_path(text: Column, path: str, value: Column | None) -> Column:
    """JSON text with ``value`` (JSON text) at a path; None deletes the place.

    Missing keys are added; ``[]`` at the end of a path appends to the array.
    """
    parts = segments(path)
    new = None if value is None else F.parse_json(value)
    if isinstance(parts[0], str):
        return F.to_json(_with_entry(F.from_json(text, _MAP), parts[0], parts[1:], new))
    return F.to_json(_with_value(F.try_parse_json(text), parts, new))


# ---------------------------------------------------------------------- print

# Characters with an escape of their own, and how it is spelled.
_SPECIALS = (
    ("\\", "\\\\"),
    ('"', '\\"'),
    ("\b", "\\b"),
    ("\t", "\\t"),
    ("\n", "\\n"),
    ("\v", "\\v"),
    ("\f", "\\f"),
    ("\r", "\\r"),
)
_CONTROLS = [*range(0x00, 0x08), *range(0x0E, 0x20), 0x7F]


def escape(text: Column) -> Column:
    """Text as the inside of a JSON string."""
    for char, spelled in _SPECIALS:
        text = F.replace(text, F.lit(char), F.lit(spelled))
    spelled_out = text
    for code in _CONTROLS:
        spelled_out = F.replace(spelled_out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(text.rlike("[\\x00-\\x07\\x0e-\\x1f\\x7f]"), spelled_out).otherwise(text)


def unescape(text: Column) -> Column:
    """The text behind the inside of a JSON string; NULL for any other escape."""
    known = text.rlike(r'^(?s:[^\\]|\\["\\/bfnrt]|\\u00[0-9a-fA-F]{2})*+$')
    bare = F.regexp_replace(text, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    options = {"allowUnquotedControlChars": "true"}
    parsed = F.from_json(F.concat(F.lit('["'), bare, F.lit('"]')), "array<string>", options)
    return F.when(known, parsed[0])


def quoted(text: Column) -> Column:
    """``%Q``: quoted and escaped, or null."""
    return F.coalesce(F.concat(F.lit('"'), escape(text), F.lit('"')), F.lit("null"))


def quoted_text(text: str) -> str:
    """The same of a Python string."""
    for char, spelled in [*_SPECIALS, *((chr(code), f"\\u{code:04x}") for code in _CONTROLS)]:
        text = text.replace(char, spelled)
    return f'"{text}"'


def hex_string(data: Column) -> Column:
    """``%H``: quoted lower-case hexadecimal."""
    return F.concat(F.lit('"'), F.lower(F.hex(data)), F.lit('"'))


def base64_string(data: Column) -> Column:
    """``%V``: quoted base64."""
    unbroken = F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit('"'), unbroken, F.lit('"'))


def print_object(**columns: Column) -> Column:
    """One JSON object per row; NULL columns are written as null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def print_array(column: Column) -> Column:
    return F.to_json(column)


_PIECE = 256
_TOKENS = r'("(?:\\.|[^"\\])*+"|[{}\[\],:]|[^\s{}\[\],:"]++)'


def prettify(text: Column) -> Column:
    """JSON text with one value per line, two spaces per level.

    Works on the tokens of the text itself: order and spelling stay as they are. The
    lines of a piece of tokens are put together, and the pieces joined once at the end.
    """

    def line(level: Column) -> Column:
        return F.concat(F.lit("\n"), F.repeat(F.lit("  "), level))

    def step(acc: Column, tok: Column) -> Column:
        closing, opening = tok.isin("}", "]"), tok.isin("{", "[")
        level = F.when(closing, acc["level"] - 1).otherwise(acc["level"])
        opened = acc["last"].isin("{", "[")
        fresh = ~tok.isin(",", ":") & (acc["last"] != ":") & (acc["last"] != "")
        lead = (
            F.when(tok == ",", F.lit(","))
            .when(tok == ":", F.lit(": "))
            .when(closing, F.when(opened, tok).otherwise(F.concat(line(level), tok)))
            .when(fresh, F.concat(line(level), tok))
            .otherwise(tok)
        )
        after = F.when(opening, level + 1).otherwise(level)
        return F.struct(F.concat(acc["out"], lead).alias("out"), after.alias("level"), tok.alias("last"))

    def piece(tokens: Column, acc: Column, i: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), acc["level"].alias("level"), acc["last"].alias("last"))
        written = F.aggregate(F.slice(tokens, i * _PIECE + 1, _PIECE), start, step)
        # bound by a lambda, so that it is worked out once
        return F.aggregate(
            F.array(written),
            acc,
            lambda a, w: F.struct(
                F.array_append(a["parts"], w["out"]).alias("parts"), w["level"].alias("level"), w["last"].alias("last")
            ),
        )

    def joined(tokens: Column) -> Column:
        start = F.struct(
            F.array().cast("array<string>").alias("parts"), F.lit(0).alias("level"), F.lit("").alias("last")
        )
        pieces = F.sequence(F.lit(0), F.floor(F.size(tokens) / _PIECE).cast("int"))
        return F.aggregate(pieces, start, lambda acc, i: piece(tokens, acc, i), lambda acc: F.concat_ws("", acc["parts"]))

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), 1)
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(tokens), joined), 1))
