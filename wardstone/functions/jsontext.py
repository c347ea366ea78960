"""String leaves of JSON texts, whatever their shape and depth."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

LEAF = "struct<path:string,start:int,end:int,value:string>"


TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|([\[\]{},:])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def leaves(text: str) -> list[dict] | None:
    """The string values of a JSON text with their path (``a.b.[0]``) and the place of their
    literal, quotes included; null if the text is malformed. An explicit stack, no recursion.

    The parser of the standard library judges most texts; one nested deeper than it goes is judged
    token by token by the scan itself."""
    strict = False
    try:
        json.loads(text)
    except RecursionError:
        strict = True
    except ValueError:
        return None
    return scanned(text) if strict else found(text)


def found(text: str) -> list[dict]:
    """The leaves of a text known to be well formed."""
    out: list[dict] = []
    stack: list[list] = []  # [is an object, key or index]
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]', text):
        token = m[0]
        top = stack[-1] if stack else None
        if token in "{[":
            stack.append([token == "{", None if token == "{" else 0])
        elif token in "}]":
            stack.pop()
        elif token == ",":
            top[1] = None if top[0] else top[1] + 1
        elif token != ":":
            if top is not None and top[0] and top[1] is None:
                top[1] = json.loads(token)
            else:
                out.append({"path": path_of(stack), "start": m.start(), "end": m.end(), "value": json.loads(token)})
    return out


def path_of(stack: list[list]) -> str:
    return ".".join(key if is_object else f"[{key}]" for is_object, key in stack)


def scanned(text: str) -> list[dict] | None:
    """The leaves of any text, or null where a token stands that may not."""
    out: list[dict] = []
    stack: list[list] = []
    state, at = "value", 0  # what may come: value, first (value or end), key, first key, colon, next (comma or end), done
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            break
        at = m.end()
        string, mark, plain = m.groups()
        if state == "done":
            return None
        if string is not None and state in ("key", "first key"):
            stack[-1][1], state = json.loads(string), "colon"
        elif (string is not None or plain is not None) and state in ("value", "first"):
            if string is not None:
                out.append({"path": path_of(stack), "start": m.start(1), "end": m.end(1), "value": json.loads(string)})
            state = "next" if stack else "done"
        elif mark == ":" and state == "colon":
            state = "value"
        elif mark in ("{", "[") and state in ("value", "first"):
            stack.append([mark == "{", None if mark == "{" else 0])
            state = "first key" if mark == "{" else "first"
        elif mark == "," and state == "next":
            top = stack[-1]
            top[1], state = (None, "key") if top[0] else (top[1] + 1, "value")
        elif (mark == "}" and state in ("next", "first key") and stack[-1][0]) or (mark == "]" and state in ("next", "first") and not stack[-1][0]):
            stack.pop()
            state = "next" if stack else "done"
        else:
            return None
    return out if state == "done" and not text[at:].strip(" \t\n\r") else None


def json_strings(column: Column) -> Column:
    """An array of LEAF per JSON text. What is done with the leaves stays in Spark expressions."""

    @F.arrow_udf(f"array<{LEAF}>")
    def scan(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        return pa.array([None if t is None else leaves(t) for t in texts.to_pylist()], kind)

    return scan(column)
