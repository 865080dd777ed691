"""Fill-in-the-middle: a text is cut at two places and its parts are put in another order.

A text is a row of units: lines, words with the white space behind them, or code points.  Its bytes
are run-length coded by character class (line ends and the rest, white space and ink, or the
width of a character); every maximal run keeps how many units end in it, how far apart their ends
are, and how many end before it.  The place of a cut after k units is then found by binary
search for the run that holds the k-th end and one multiplication inside it: no list of units is made,
and a text of a million short lines costs as much as its runs.

Draws come from the digest of seed and id alone, so reruns and any partitioning agree.  The output
is rebuilt by `restored`, in the JVM.

Defined results: null and empty texts are plain and empty; a text that holds a sentinel stays as it
is (plain), since it could not be told from the format; rows with the same id have the same
draws; a null id draws as an empty one; a text of any length is one unit of work, taken whole; columns in
keep pass through, except where a column of the result has the name; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, fresh, pieces, raw

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
UNITS = ("lines", "words", "chars")
MADE = ("n_units", "form", "output", "prefix_chars", "middle_chars")
_WIDTH = np.zeros(256, np.uint8)  # bytes of the character that a byte begins; 0 inside one
for _lo, _hi, _n in ((0x00, 0x80, 1), (0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
    _WIDTH[_lo:_hi] = _n


@dataclass
class Runs:
    """The runs of a block of texts: begin, distance between the ends of units, units ended before each run."""

    begin: np.ndarray
    step: np.ndarray
    before: np.ndarray
    lead: np.ndarray  # of each text: units ended before it
    units: np.ndarray  # of each text
    offsets: np.ndarray

    def place(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th unit of a text (its begin for none)."""
        g = self.lead[text] + k
        r = np.maximum(np.searchsorted(self.before, g, "left") - 1, 0)
        return np.where(k > 0, self.begin[r] + (g - self.before[r]) * self.step[r], self.offsets[text]) if len(self.begin) else self.offsets[text]


def runs(data: np.ndarray, offsets: np.ndarray, unit: str) -> Runs:
    """Of texts that lie one after another: maximal runs of one character class, none across texts."""
    n, texts = len(data), len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Runs(z, z, np.zeros(1, np.int64), np.zeros(texts, np.int64), np.zeros(texts, np.int64), offsets)
    if unit == "chars":
        kind = _WIDTH[data]
        head = np.maximum.accumulate(np.where(kind > 0, np.arange(n), 0))
        kind = kind[head]
    else:
        kind = (data == 10 if unit == "lines" else _SPACE[data]).astype(np.uint8)
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    full = np.flatnonzero(np.diff(offsets) > 0)
    edge[offsets[full]] = True
    begin = np.flatnonzero(edge)
    size = np.diff(np.append(begin, n))
    kind = kind[begin].astype(np.int64)
    if unit == "chars":
        step, ends = kind, size // kind
    else:
        step = np.ones(len(begin), np.int64) if unit == "lines" else size.copy()
        ends = np.where(kind == 1, size if unit == "lines" else 1, 0)
        last = np.searchsorted(begin, offsets[full + 1] - 1, "right") - 1
        last = last[kind[last] == 0]  # the end of the text ends a unit too
        ends[last], step[last] = 1, size[last]
    before = np.concatenate([[0], np.cumsum(ends)])
    at = np.searchsorted(begin, offsets)
    return Runs(begin, step, before, before[at[:-1]], np.diff(before[at]), offsets)


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _check(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may lie in another or begin inside one, or the output would not read back."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


def transform(
    docs: DataFrame, unit: str = "lines", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """docs (the columns in keep, else all) with n_units, form (plain, psm, spm), output, and the code
    points of prefix and middle (null where plain)."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    _check(sentinels)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    pre, suf, mid = marks = [s.encode() for s in sentinels]

    def block(data: np.ndarray, off: np.ndarray, h: list[np.ndarray]) -> list[pa.Array]:
        r = runs(data, off, unit)
        n, every = r.units, np.arange(len(off) - 1)
        one, two = h[0] % (n + 1), h[1] % (n + 1)
        a, b = r.place(every, np.minimum(one, two)), r.place(every, np.maximum(one, two))
        ahead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
        whole = data.tobytes()
        out, form = [], []
        for x, y, p, q, f, s in zip(off[:-1].tolist(), off[1:].tolist(), a.tolist(), b.tolist(), (h[2] % 100 >= fim_percent).tolist(), (h[3] % 100 < spm_percent).tolist(), strict=True):
            if f or x == y or any(whole.find(m, x, y) >= 0 for m in marks):
                form.append("plain")
                out.append(whole[x:y])
            elif s:
                form.append("spm")
                out.append(b"".join((suf, whole[q:y], pre, whole[x:p], mid, whole[p:q])))
            else:
                form.append("psm")
                out.append(b"".join((pre, whole[x:p], suf, whole[q:y], mid, whole[p:q])))
        kinds = pa.array(form, pa.string())
        plain = np.array([f == "plain" for f in form], bool)
        counted = lambda v: pa.array(v, pa.int64(), mask=plain)
        return [pa.array(n, pa.int64()), kinds, pa.array(out, pa.binary()).cast(pa.string()), counted(ahead[a] - ahead[off[:-1]]), counted(ahead[b] - ahead[a])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column=text):
            data, off = raw(b.column(text))
            h = [b.column(c).to_numpy() for c in drawn]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *block(data, off, h)], [*keep, *MADE])

    text, drawn = fresh(docs, "fim_text"), [fresh(docs, f"fim_{i}") for i in range(4)]
    src = docs.select(*keep, F.col(text_col).alias(text), *[h.alias(c) for c, h in zip(drawn, draws(F.col(id_col), seed), strict=True)])
    own = "n_units long, form string, output string, prefix_chars long, middle_chars long"
    return src.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *T.StructType.fromDDL(own)]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform was given; every sentinel stands once in what is not plain."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
