"""Literals of the server's language: reading them into typed values and writing typed values as literals."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from worldloom.functions.moo import ERRORS

_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:\\.|[^"\\])*")|(?P<float>[-+]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][-+]?\d+)?)|(?P<obj>#-?\d+)|(?P<int>[-+]?\d+)|(?P<arrow>->)|(?P<mark>[{}\[\],])|(?P<word>[A-Za-z_*][\w*]*(?: #?-?\d+)?))')


class LiteralError(ValueError):
    """The text is no literal; says where, not what."""


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise LiteralError(f"no literal at position {at}")
        yield m.lastgroup, m.group(m.lastgroup)
        at = m.end()
    yield "end", ""


def parse(text: str) -> dict:
    """The typed value a literal stands for: integers, floats, strings, objects, errors, lists, maps, booleans."""
    tokens = _tokens(text)
    kind, tok = next(tokens)

    def step() -> None:
        nonlocal kind, tok
        kind, tok = next(tokens)

    def need(mark: str) -> None:
        if tok != mark:
            raise LiteralError(f"expected {mark}")
        step()

    def value() -> dict:
        k, t = kind, tok
        if k == "end":
            raise LiteralError("unexpected end")
        if t in ("{", "["):
            return several(t)
        step()
        if k == "string":
            return {"type": "string", "value": re.sub(r"\\(.)", r"\1", t[1:-1], flags=re.S)}
        if k == "float":
            return {"type": "float", "bits": struct.pack(">d", float(t)).hex()}
        if k == "obj":
            return {"type": "obj", "value": t[1:]}
        if k == "int":
            return {"type": "int", "value": str(int(t))}
        if k == "word" and t.upper() in ERRORS:
            return {"type": "error", "value": str(ERRORS.index(t.upper()))}
        if k == "word" and t.lower() in ("true", "false"):
            return {"type": "bool", "value": t.lower() == "true"}
        raise LiteralError("unknown word" if k == "word" else "unexpected end or mark")

    def several(opening: str) -> dict:
        closing = "}" if opening == "{" else "]"
        step()
        items = []
        while tok != closing:
            first = value()
            if opening == "[":
                need("->")
                items.append({"key": first, "value": value()})
            else:
                items.append(first)
            if tok != closing:
                need(",")
                if tok == closing:
                    raise LiteralError("nothing after a comma")
        step()
        return {"type": "list", "items": items} if opening == "{" else {"type": "map", "entries": items}

    out = value()
    if kind != "end":
        raise LiteralError("more text after the literal")
    return out


def render(v: dict, limit: int | None = None) -> str:
    """A typed value as a literal; ``limit`` cuts the text and marks the cut with three dots."""
    text = _render(v)
    return text if limit is None or len(text) <= limit else text[: max(0, limit - 3)] + "..."


def _render(v: dict) -> str:
    kind = v["type"]
    if kind == "list":
        return "{" + ", ".join(map(_render, v["items"])) + "}"
    if kind == "map":
        return "[" + ", ".join(f"{_render(e['key'])} -> {_render(e['value'])}" for e in v["entries"]) + "]"
    if kind == "string":
        return '"' + v["value"].replace("\\", "\\\\").replace('"', '\\"') + '"'
    if kind == "obj":
        return f"#{v['value']}"
    if kind == "error":
        n = int(v["value"])
        return ERRORS[n] if 0 <= n < len(ERRORS) else f"E_{n}"
    if kind == "float":
        x = struct.unpack(">d", bytes.fromhex(v["bits"]))[0]
        text = f"{x:.15g}"
        return text if re.search(r"[.en]", text) else text + ".0"
    if kind == "bool":
        return "true" if v["value"] in (True, "true") else "false"
    if kind in ("anon", "waif"):
        return f"*{kind} {v['value']}*"
    return v["value"] if kind == "int" else f"<{kind}>"


@F.pandas_udf(StringType())
def _literal_udf(values: pd.Series, limit: pd.Series) -> pd.Series:
    def one(t: str | None, n: int) -> str | None:
        try:
            return None if t is None else render(json.loads(t), None if n < 0 else n)
        except (ValueError, KeyError, TypeError):
            return None

    return pd.Series([one(t, int(n)) for t, n in zip(values, limit)], dtype=object)


@F.pandas_udf(StringType())
def _parse_udf(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(parse(t), ensure_ascii=False)
        except LiteralError:
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def literal_of(value_json: Column | str, limit: int | None = None) -> Column:
    """Typed JSON as a literal; null where it is no typed value."""
    c = F.col(value_json) if isinstance(value_json, str) else value_json
    return _literal_udf(c, F.lit(-1 if limit is None else limit))


def value_of(literal: Column | str) -> Column:
    """Typed JSON of a literal; null where the text is none."""
    return _parse_udf(F.col(literal) if isinstance(literal, str) else literal)
