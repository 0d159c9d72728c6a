"""JSON by the places of its tokens: where every value stands, and changes in place.

Both work on the tokens of the text itself, so that what is not asked for keeps its order,
spelling and spaces. Keys may be bare identifiers
(``{a: 1}``); ``quote_keys`` makes such text fit for the functions of ``jsons``.
Text that is no JSON otherwise (hexadecimal numbers, left-out commas, repeated keys)
gives NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from readsieve.functions.jsons import quoted_text, segments, unescape

_STRING = r'"(?:\\.|[^"\\])*+"'
_TOKEN = rf'\s*+(?:{_STRING}|[{{}}\[\],:]|[^\s{{}}\[\],:"]++)'
_KEY = r'"((?:\\.|[^"\\])*+)"|(?<![\w.+-])([A-Za-z][A-Za-z0-9_]*+)(?=\s*:)'
_SPACE = " \t\n\r"
_PIECE = 256


def quote_keys(text: Column) -> Column:
    """The text with its bare keys in quotes; anything else stays as it is."""
    return F.regexp_replace(text, _KEY, '"$1$2"')


def is_json(text: Column) -> Column:
    return F.try_parse_json(quote_keys(text)).isNotNull()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _key_of(token: Column) -> Column:
    inside = F.when(F.startswith(token, F.lit('"')), F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(token)
    return F.when(F.contains(inside, F.lit("\\")), unescape(inside)).otherwise(inside)


def _fields(types: str) -> list[str]:
    """Names of the outermost fields of a list of types."""
    return re.findall(r"(\w+):", re.sub(r"<(?:[^<>]|<[^<>]*>)*>", "", types))


def _record(types: str, acc: Column, **changed: Column) -> Column:
    """``acc`` with some fields changed, in the order of its type."""
    return F.struct(*[(changed[n] if n in changed else acc[n]).alias(n) for n in _fields(types)])


def _placed(token: Column, off: Column, size: Callable[[Column], Column]) -> Column:
    """A token without the spaces before it, its start and its end."""
    bare = F.ltrim(token, F.lit(_SPACE))
    end = off + size(token)
    return F.struct(bare.alias("t"), (end - size(bare)).alias("at"), end.alias("end"))


# ---------------------------------------------------------------------- spans

_FRAME = "path:string,name:string,obj:boolean,n:int,at:int"
_SPAN = "path:string,name:string,type:string,at:int,length:int"
_SCAN = f"off:int,path:string,name:string,obj:boolean,n:int,at:int,key:string,is_key:boolean,above:array<struct<{_FRAME}>>,out:array<struct<{_SPAN}>>"


def _scan_step(acc: Column, token: Column, size: Callable[[Column], Column]) -> Column:
    def step(p: Column) -> Column:
        t = p["t"]
        first = F.left(t, F.lit(1))
        inner_name = F.when(acc["obj"], acc["key"]).when(acc["obj"].isNotNull(), acc["n"].cast("string"))
        inner_path = (
            F.when(acc["obj"], F.concat(acc["path"], F.lit("."), acc["key"]))
            .when(acc["obj"].isNotNull(), F.concat(acc["path"], F.lit("["), acc["n"].cast("string"), F.lit("]")))
            .otherwise(F.lit(""))
        )
        frame = F.struct(*[acc[n].alias(n) for n in ("path", "name", "obj", "n", "at")])
        opened = _record(
            _SCAN,
            acc,
            off=p["end"],
            path=inner_path,
            name=inner_name,
            obj=t == "{",
            n=F.lit(0),
            at=p["at"],
            key=F.lit(None).cast("string"),
            is_key=t == "{",
            above=F.array_append(acc["above"], frame),
        )
        whole = F.struct(
            acc["path"].alias("path"),
            acc["name"].alias("name"),
            F.when(acc["obj"], F.lit("object")).otherwise(F.lit("array")).alias("type"),
            acc["at"].alias("at"),
            (p["end"] - acc["at"]).alias("length"),
        )
        parent = F.element_at(acc["above"], -1)
        closed = _record(
            _SCAN,
            acc,
            off=p["end"],
            **{n: parent[n] for n in ("path", "name", "obj", "n", "at")},
            is_key=F.lit(False),
            above=F.slice(acc["above"], 1, F.size(acc["above"]) - 1),
            out=F.array_append(acc["out"], whole),
        )
        is_string = first == '"'
        scalar = F.struct(
            inner_path.alias("path"),
            inner_name.alias("name"),
            F.when(is_string, F.lit("string")).when(t.isin("true", "false", "null"), t).otherwise(F.lit("number")).alias("type"),
            F.when(is_string, p["at"] + 1).otherwise(p["at"]).alias("at"),
            F.when(is_string, p["end"] - p["at"] - 2).otherwise(p["end"] - p["at"]).alias("length"),
        )
        return (
            F.when(t.isin("{", "["), opened)
            .when(t.isin("}", "]"), closed)
            .when(t == ",", _record(_SCAN, acc, off=p["end"], n=acc["n"] + 1, is_key=F.coalesce(acc["obj"], F.lit(False))))
            .when(t == ":", _record(_SCAN, acc, off=p["end"]))
            .when(acc["is_key"], _record(_SCAN, acc, off=p["end"], key=_key_of(t), is_key=F.lit(False)))
            .otherwise(_record(_SCAN, acc, off=p["end"], out=F.array_append(acc["out"], scalar)))
        ).cast(f"struct<{_SCAN}>")

    return _let(_placed(token, acc["off"], size), step)


def spans(text: Column, unit: str = "characters") -> Column:
    """Array of ``(path, name, type, at, length)`` of every value, inner ones before those around them.

    ``at`` counts from 0 in characters, or in ``bytes`` of UTF-8. Objects and arrays have
    their brackets in their span, strings don't have their quotes. NULL for what is no JSON.
    The values of a piece of tokens are gathered, and the pieces joined once at the end.
    """
    size = {"characters": F.length, "bytes": F.octet_length}[unit]
    none = F.lit(None)
    start = F.struct(
        F.lit(0), F.lit(""), none, none, F.lit(0), F.lit(0), none, F.lit(False), F.array(), F.array()
    ).cast(f"struct<{_SCAN}>")
    held = f"struct<state:struct<{_SCAN}>,parts:array<array<struct<{_SPAN}>>>>"

    def piece(tokens: Column, acc: Column, i: Column) -> Column:
        state = F.aggregate(
            F.slice(tokens, i * _PIECE + 1, _PIECE), acc["state"], lambda a, tok: _scan_step(a, tok, size)
        )

        def kept(s: Column) -> Column:
            fresh = _record(_SCAN, s, out=F.array().cast(f"array<struct<{_SPAN}>>"))
            return F.struct(fresh.alias("state"), F.array_append(acc["parts"], s["out"]).alias("parts")).cast(held)

        return _let(state, kept)

    def found(tokens: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor(F.size(tokens) / _PIECE).cast("int"))
        first = F.struct(start.alias("state"), F.array().alias("parts")).cast(held)
        return F.aggregate(pieces, first, lambda acc, i: piece(tokens, acc, i), lambda acc: F.flatten(acc["parts"]))

    return F.when(is_json(text), _let(F.regexp_extract_all(text, F.lit(_TOKEN), 0), found))


# --------------------------------------------------------------------- splice

_TOKENS = re.compile(_TOKEN, re.ASCII)
_ESCAPED = re.compile(r'(?:[^\\]|\\["\\/bfnrt]|\\u00[0-9a-fA-F]{2})*+', re.DOTALL)
_ESCAPE = re.compile(r"\\(u00[0-9a-fA-F]{2}|.)", re.DOTALL)
_MEANT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _key_text(token: str) -> str | None:
    """What ``_key_of`` makes of a key."""
    inside = token[1:-1] if token[0] == '"' else token
    if "\\" not in inside:
        return inside
    if not _ESCAPED.fullmatch(inside):
        return None
    return _ESCAPE.sub(lambda e: chr(int(e[1][1:], 16)) if len(e[1]) > 1 else _MEANT.get(e[1], e[1]), inside)


@dataclass
class _Place:
    """Where a path leads in a text, by character offsets.

    ``m`` parts of the path are matched by the containers that are open; the innermost of these,
    ``host``, is where a missing part would be added: before ``host_end``. ``span`` counts the parts
    that the value from ``start`` to ``end`` is at, or one on the way that can't hold the next part.
    ``pair`` begins its key, ``before`` and ``after`` are the commas beside it.
    """

    host: int = -1
    host_end: int = -1
    host_empty: bool = False
    span: int = -1
    start: int = -1
    end: int = -1
    pair: int = -1
    before: int = -1
    after: int = -1


def _place_of(text: str, parts: list[str | int | None]) -> _Place:
    """One pass over the tokens of a JSON text, which ends where all is known."""
    found = _Place()
    depth, m, n, in_object, key, key_at, is_key, comma = 0, -1, 0, False, None, -1, False, -1
    before_it, before_end = "", 0
    span_depth = -1
    for match in _TOKENS.finditer(text):
        t, end = match[0].lstrip(_SPACE), match.end()
        at, inside = end - len(t), depth == m + 1
        if t == "}" or t == "]":
            depth -= 1
            is_key = False
            if inside:
                if found.host == m:
                    found.host_end, found.host_empty = before_end, before_it in ("{", "[")
                m -= 1
                if m >= 0:
                    n, in_object = parts[m] if isinstance(parts[m], int) else -1, isinstance(parts[m], str)
            if found.span >= 0 and found.end < 0 and depth == span_depth:
                found.end = end
            elif found.span >= 0 and found.end >= 0 and depth < span_depth:
                break  # the value's container is closed
        elif t == ",":
            if inside:
                if found.span == m + 1 and found.end >= 0 and found.after < 0:
                    found.after = at
                    break
                n, is_key, comma = n + 1, in_object, at
        elif t == ":":
            pass
        elif inside and is_key:
            key, key_at, is_key = _key_text(t), at, False
        else:
            opens = t == "{" or t == "["
            there = inside and found.span < 0 and (m < 0 or (key if in_object else n) == parts[m])
            if there and m < 0:
                in_object = False
            if there and m + 1 < len(parts) and t == ("{" if isinstance(parts[m + 1], str) else "["):
                m += 1
                n, in_object, is_key, comma, found.host = 0, t == "{", t == "{", -1, m
            elif there:
                found.span, found.start, span_depth = m + 1, at, depth
                found.end = -1 if opens else end
                found.pair, found.before = key_at if in_object else at, comma
            depth += opens
        before_it, before_end = t, end
    return found


def _wrapped(parts: list[str | int | None], value: str) -> str | None:
    """The value inside new objects and arrays; None where an index would be made up."""
    for part in reversed(parts):
        if isinstance(part, int):
            return None
        value = f"[{value}]" if part is None else f"{{{quoted_text(part)}:{value}}}"
    return value


def _without(text: str, s: _Place) -> str:
    if s.before >= 0:
        return text[: s.before] + text[s.end :]
    return text[: s.pair] + text[s.after + 1 if s.after >= 0 else s.end :]


def _with(text: str, parts: list[str | int | None], value: str, s: _Place) -> str:
    if s.span == len(parts):
        return text[: s.start] + value + text[s.end :]
    at = s.host if s.span < 0 else s.span
    whole = _wrapped(parts[at:], value)
    if whole is None:
        return text
    if s.span >= 0:
        return text[: s.start] + whole + text[s.end :]
    # without its outermost brackets, as they are there
    inner, comma = whole[1:-1], "" if s.host_empty else ","
    return text[: s.host_end] + comma + inner + text[s.host_end :]


def splice(text: Column, path: str, value: Column | None) -> Column:
    """The text with ``value`` (JSON text) at a path, all else letter for letter as it was.

    None deletes the place, with one comma. A missing key comes last in its object, ``[]`` last
    in its array; a value that can't hold the next part of the path gives way to one that can. An index that an array
    doesn't have changes nothing. NULL if text or value is NULL or no JSON.

    Spark's variant type tells what is JSON; the place is looked up by Arrow tasks.
    """
    parts = segments(path)
    if not parts:
        raise ValueError("an empty path names no place")

    def removed(given: str | None) -> str | None:
        if given is None:
            return None
        place = _place_of(given, parts)
        return _without(given, place) if place.span == len(parts) else given

    def written(given: str | None, new: str | None) -> str | None:
        return None if given is None or new is None else _with(given, parts, new, _place_of(given, parts))

    if value is None:
        return F.udf(removed, "string", useArrow=True)(F.when(is_json(text), text))
    fit = is_json(text) & F.try_parse_json(value).isNotNull()
    return F.udf(written, "string", useArrow=True)(F.when(fit, text), value)
