"""Text, tables and JSON of pages that were fetched; text lines of results of any size."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators.page import Page


#: Fixed values of the text format: title and width of each column (negative: to the right; 0: as it is, one
#: space before; None: as it is, two spaces before).
LAYOUTS: dict[str, tuple[tuple[str, str, int | None], ...]] = {
    "findrefs": (("dex", "dex", 10), ("kind", "kind", 12), ("class", "class", None), ("method", "method", 0), ("refs", "refs", None)),
    "members": (("dex", "dex", 10), ("kind", "kind", 6), ("class", "class", None), ("member", "member", 0)),
    "hierarchy": (("dex", "dex", 10), ("relation", "relation", 9), ("class", "class", None)),
    "largest": (("units", "insns", -7), ("dex", "dex", 10), ("class", "class", None), ("method", "method", 0)),
    "res": (("method", "method", 8), ("compressed_size", "size", -9), ("name", "entry", None)),
}


def _padded(text: Column, width: int | None) -> Column:
    """Text of a width at least; longer text is not cut."""
    if not width:
        return text
    pad = F.lpad if width < 0 else F.rpad
    return pad(text, F.greatest(F.lit(abs(width)), F.length(text)), F.lit(" "))


def lines(rows: DataFrame, command: str) -> DataFrame:
    """line: every row as the command prints it, lists joined by `; `; nothing comes to the driver."""
    parts: list[Column] = []
    for k, (name, _, width) in enumerate(LAYOUTS[command]):
        listed = rows.schema[name].dataType.typeName() == "array"
        shown = F.array_join(name, "; ") if listed else F.coalesce(F.col(name).cast("string"), F.lit("-"))
        parts += [F.lit(" " if width == 0 else "  ")] * (k > 0) + [_padded(shown, width)]
    return rows.select(F.concat(*parts).alias("line"))


def header(command: str) -> str:
    """The line of titles over lines()."""
    out = ""
    for k, (_, title, width) in enumerate(LAYOUTS[command]):
        shown = title.rjust(-width) if (width or 0) < 0 else title.ljust(width or 0)
        out += (" " if width == 0 else "  ") * (k > 0) + shown
    return out


def plain(v: object) -> str:
    if v is None:
        return "-"
    return "; ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)


def text(rows: Iterable[Row]) -> str:
    return "".join("\t".join(plain(v) for v in r) + "\n" for r in rows)


def tree(rows: Iterable[Row], weights: bool = False) -> str:
    """Groups as path/ (n); leaves with their weight only if asked for and above one."""
    out = []
    for r in rows:
        if r.kind == "package":
            some = f"  e.g. {', '.join(r.samples)}" if "samples" in r.__fields__ and r.samples else ""
            out.append(f"{r.path}/ ({r[2]}){some}")
        else:
            out.append(f"{r.path} ({r[2]})" if weights and r[2] > 1 else r.path)
    return "\n".join(out) + ("\n" if out else "")


def table(rows: list[Row], markdown: bool = False) -> str:
    if not rows:
        return ""
    names = list(rows[0].__fields__)
    cells = [[plain(v).replace("|", "\\|") if markdown else plain(v) for v in r] for r in rows]
    width = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    line = lambda c: ("| " if markdown else "") + (" | " if markdown else "  ").join(x.ljust(w) for x, w in zip(c, width, strict=True)).rstrip() + (" |" if markdown else "")
    rule = line(["-" * w for w in width])
    return "\n".join([line(names), rule, *map(line, cells)]) + "\n"


def to_json(page: Page, key: str = "data", **more) -> str:
    """The page in its envelope; a whole result without a window is a bare list."""
    rows = [r.asDict(recursive=True) for r in page.rows]
    if not page.limit and not page.offset and not more:
        return json.dumps(rows, ensure_ascii=False)
    return json.dumps(page.envelope(**more) | {key: rows}, ensure_ascii=False)


def json_lines(rows: Iterable[Row]) -> str:
    return "".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n" for r in rows)


FORMATS = {"text": text, "table": table, "markdown": lambda r: table(r, True), "jsonl": json_lines}
