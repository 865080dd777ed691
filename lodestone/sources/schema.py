"""Table schemas as text, readable on executors and in planning processes, where no session is."""

from __future__ import annotations

import re

import pyarrow as pa

_PLAIN = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def fields(ddl: str) -> dict[str, str]:
    """name -> type of `name type, name type`; types may nest."""
    out, depth, begin = {}, 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = re.fullmatch(r"\s*(\w+)\s*:?\s*(.+?)\s*", ddl[begin:i]).groups()
            out[name] = kind
            begin = i + 1
    return out


def arrow_type(kind: str) -> pa.DataType:
    if kind in _PLAIN:
        return _PLAIN[kind]
    outer, inner = re.fullmatch(r"(\w+)<(.*)>", kind).groups()
    if outer == "array":
        return pa.list_(arrow_type(inner))
    if outer == "map":
        return pa.map_(*(arrow_type(k.strip()) for k in inner.split(",", 1)))
    return pa.struct([pa.field(n, arrow_type(k)) for n, k in fields(inner).items()])


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(n, arrow_type(k)) for n, k in fields(ddl).items()])


def chosen(ddl: str, columns: list[str] | None) -> str:
    """The schema of some of its columns, in the order asked for."""
    have = fields(ddl)
    if columns is None:
        return ddl
    if missing := [c for c in columns if c not in have]:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(have)}")
    return ", ".join(f"{c} {have[c]}" for c in columns)
