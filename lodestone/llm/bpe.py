"""Byte-level BPE encoding and decoding with a transducer lexicon.

Frequent words of the corpus, with the ids they encode to, are compiled into a minimal acyclic
transducer: words share prefixes and suffixes, arcs carry the number of words they pass over, so
that the sum along a path is the word's row in a table of ids.  The automaton is one flat blob;
each Python worker maps it into memory from an unnamed file.  The different words of a block of
texts walk through it together; those that are not in it are merged exactly by the vocabulary's
merge ranks, also together.  So the lexicon only decides the speed, never the result.

Which words are frequent is counted over all texts: every partition reports the words whose share
of its words is at least `share`; a word whose share of the whole corpus is that large has it in
at least one partition, so none is missed.  The lexicon keeps the `lexicon_size` largest.

Defined results: null text encodes as empty, an empty table to an empty one; an added token of the
vocabulary written in a text is one id; decoding joins the bytes of all ids and reads them as
UTF-8 with replacement; null ids decode to an empty text; a text of any length is one row, taken
whole (a very long one makes a block of its own); extra columns pass through, those named like
the results are replaced; repeated rows stay rows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, raw, text_column, with_text

SLICE = 1 << 20  # bytes of text in a block
LONG = 64  # bytes of a word beyond which it is merged by a heap, and never in the lexicon
CELLS = 1 << 19  # bytes of words merged together


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the ranges begin..begin+size, one range after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


# ---------------------------------------------------------------- words
OTHER, LETTER, DIGIT, WHITE = range(4)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every, out = "".join(map(chr, points)), np.zeros(0x110000, np.uint8)
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    return out


def word_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of a block of UTF-8 texts begin; every byte is in one word.

    A word is a run of letters, of digits or of other signs, with one space before it if there is
    one; white space before that space is a word, and so is white space that ends a text; after an
    apostrophe that begins a word, the endings s t re ve m ll d make a word of their own with it.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return at
    b = data[at]
    kind = kinds()[b]
    wide = np.flatnonzero(b >= 0x80)
    if len(wide):
        lead, size = b[wide].astype(np.int64), np.diff(np.append(at, len(data)))[wide]
        code = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
        for i in range(1, 4):
            on = size > i
            code[on] = code[on] << 6 | data[at[wide[on]] + i] & 0x3F
        kind[wide] = kinds()[code]
    m = len(at)
    first = np.zeros(m + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    edge = first.copy()
    edge[1:m] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:m])  # of white space, before a word
    edge[last] = True
    edge[last + 1] = b[last] != 0x20
    mark = np.flatnonzero((b[:-1] == 0x27) & edge[: m - 1] & (kind[1:] == LETTER) & ~first[1:m])
    if len(mark):
        one = b[mark + 1]
        second = np.where((mark + 2 < m) & ~first[np.minimum(mark + 2, m)], b[np.minimum(mark + 2, m - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == ord("r")) | (one == ord("v"))) & (second == ord("e")) | (one == ord("l")) & (second == ord("l"))
        mark, n = mark[short | double], np.where(short, 1, 2)[short | double]
        edge[mark + 1] = False
        edge[mark + 1 + n] = True
    return at[edge[:m]]


class Vocabulary:
    """Merge ranks over ids, the bytes of each id and the added tokens."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.added.values()]) + 1
        bytes_of: list[bytes] = [b""] * size
        for piece, i in ids.items():
            bytes_of[i] = bytes(letters[c] for c in piece)
        for text, i in self.added.items():
            bytes_of[i] = text.encode()
        self.piece_size = np.array([len(x) for x in bytes_of], np.int64)
        self.piece_begin = np.cumsum(self.piece_size) - self.piece_size
        self.pieces = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.single = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.single[b] = ids[c]
        pairs: dict[int, int] = {}
        result = []  # by rank
        self.size = size
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault(ids[a] * size + ids[b], n)
            result.append(ids[a + b])
        self.NONE = len(result)
        self.result = np.array([*result, 0], np.int32)
        keys, ranks = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        s = self.single.astype(np.int64)
        self.first = self.rank(np.repeat(s, 256), np.tile(s, 256)).reshape(256, 256)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of ids, NONE where they never merge."""
        if not len(self.keys):
            return np.full(len(a), self.NONE, np.int32)
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(self.NONE))

    def merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one after another, and how many each has.  In every word again and
        again the pair of least rank merges, the leftmost first; words of one length go together."""
        count = np.zeros(len(begin), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            step = CELLS // max(length, 1) if length <= LONG else 1
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                if length > LONG:
                    ids = self._long(data[begin[part[0]] : begin[part[0]] + length])[None]
                    count[part] = ids.shape[1]
                else:
                    ids, count[part] = self._together(data[begin[part][:, None] + np.arange(length)])
                done.append((part, ids, count[part]))
        out, lead = np.zeros(count.sum(), np.uint32), np.cumsum(count) - count
        for part, ids, n in done:
            on = np.arange(ids.shape[1]) < n[:, None]
            out[(lead[part][:, None] + np.arange(ids.shape[1]))[on]] = ids[on]
        return out, count

    def _together(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length, a row of bytes each: (ids, how many of each row are theirs)."""
        n, width = letters.shape
        ids, rank = self.single[letters], self.first[letters[:, :-1], letters[:, 1:]]
        out, count, live = np.zeros((n, width), np.int32), np.zeros(n, np.int64), np.arange(n)
        while width > 1 and len(live):
            best = rank.argmin(1)
            least = rank[np.arange(len(live)), best]
            on = least < self.NONE
            if not on.all():
                out[live[~on], :width], count[live[~on]] = ids[~on], width
                live, ids, rank, best, least = live[on], ids[on], rank[on], best[on], least[on]
            row = np.arange(len(live))
            ids[row, best] = self.result[least]
            ids = ids[np.arange(width) != best[:, None] + 1].reshape(len(live), width - 1)
            rank = rank[np.arange(width - 1) != best[:, None]].reshape(len(live), width - 2)
            width -= 1
            for side in (best - 1, best):
                at = np.flatnonzero((side >= 0) & (side < width - 1))
                rank[at, side[at]] = self.rank(ids[at, side[at]], ids[at, side[at] + 1])
        out[live, :width], count[live] = ids, width
        return out, count

    def _long(self, letters: np.ndarray) -> np.ndarray:
        """One long word, by a heap of its pairs."""
        ids = self.single[letters].tolist()
        n = len(ids)
        ranks = self.first[letters[:-1], letters[1:]]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(ranks[i]), int(i), ids[i], ids[i + 1]) for i in np.flatnonzero(ranks < self.NONE)]
        heapq.heapify(heap)
        dead = bytearray(n)
        rank = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True)).get if len(heap) > 5_000 else lambda key: self._one(key)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j, new = right[i], int(self.result[r])
            if dead[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], dead[j], right[i] = new, 1, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := rank(new * self.size + ids[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[right[i]]))
            if (k := left[i]) >= 0 and (r := rank(ids[k] * self.size + new)) is not None:
                heapq.heappush(heap, (r, k, ids[k], new))
        return np.array([x for i, x in enumerate(ids) if not dead[i]], np.int32)

    def _one(self, key: int) -> int | None:
        at = int(np.searchsorted(self.keys, key))
        return int(self.ranks[at]) if at < len(self.keys) and self.keys[at] == key else None


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


# ---------------------------------------------------------------- the transducer
def compile_lexicon(entries: Iterable[tuple[bytes, np.ndarray]]) -> bytes:
    """A blob of the minimal automaton of all words with their ids.

    Words come in sorted; the states of a finished suffix are looked up in a register and shared.
    Layout, all u32: arcs, states, root, words, ids | arc key (state, label) | arc target | words
    passed over by an arc | state final | id begin | ids.
    """
    entries = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    counts: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (s := register.get(key)) is None:
            s = register[key] = len(states)
            states.append(key)
            counts.append(int(node[0]) + sum(counts[t] for _, t in node[1]))
        return s

    path: list[list] = [[False, []]]  # of [final, [(label, state)]]
    last = b""
    for word, _ in entries:
        k = 0
        while k < min(len(word), len(last)) and word[k] == last[k]:
            k += 1
        while len(path) > k + 1:
            child = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], child))
        path.extend([False, []] for _ in range(len(word) - k))
        path[-1][0] = True
        last = word
    while len(path) > 1:
        child = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], child))
    root = freeze(path[0])
    keys, target, passed = [], [], []
    for s, (final, arcs) in enumerate(states):
        run = int(final)
        for label, t in arcs:
            keys.append(s << 8 | label)
            target.append(t)
            passed.append(run)
            run += counts[t]
    begin = np.cumsum([0, *[len(x) for _, x in entries]])
    ids = np.concatenate([np.zeros(0, np.uint32), *[x for _, x in entries]])
    parts = ([len(keys), len(states), root, len(entries), len(ids)], keys, target, passed, [f for f, _ in states], begin, ids)
    return np.concatenate([np.asarray(p, np.uint32) for p in parts]).tobytes()


class Lexicon:
    """A compiled lexicon, mapped into memory from an unnamed file in the worker's own temp folder
    (no other process reads it; a lost worker's successor maps its own)."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        u32 = np.frombuffer(self.map, np.uint32)
        arcs, states, self.root, self.size, n_ids = (int(x) for x in u32[:5])
        cuts = np.cumsum([5, arcs, arcs, arcs, states, self.size + 1, n_ids])
        self.keys, self.target, self.passed, self.final, self.begin, self.ids = (u32[i:j] for i, j in itertools.pairwise(cuts))

    def rows(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of each word, -1 for a word that isn't in the lexicon: all words walk together."""
        out = np.full(len(begin), -1, np.int64)
        if not self.size:
            return out
        live = np.arange(len(begin))
        state, row, depth = np.full(len(live), self.root, np.uint32), np.zeros(len(live), np.int64), 0
        while len(live):
            ends = size[live] == depth
            if ends.any():
                hit = ends & (self.final[state] == 1)
                out[live[hit]] = row[hit]
                live, state, row = live[~ends], state[~ends], row[~ends]
            key = state << np.uint32(8) | data[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            live, at = live[on], at[on]
            row, state = row[on] + self.passed[at], self.target[at]
            depth += 1
        return out


class Encoder:
    def __init__(self, path: str, blob: bytes):
        import regex

        self.vocab, self.lexicon = vocabulary(path), Lexicon(blob)
        added = sorted(self.vocab.added, key=len, reverse=True)
        self.added = [t.encode() for t in added]
        self.find = regex.compile(b"|".join(regex.escape(t) for t in self.added)).finditer if added else None

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a block of texts, one after another; how many each text has)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        whole = data.tobytes()
        special = []
        if any(t in whole for t in self.added):
            for i, j in itertools.pairwise(offsets.tolist()):
                special += [(i + m.start(), i + m.end(), self.vocab.added[m.group().decode()]) for m in self.find(whole[i:j])]
        cuts = np.array(special, np.int64).reshape(-1, 3)
        begin = word_begins(data, np.unique(np.concatenate([offsets, cuts[:, 0], cuts[:, 1]])))
        if len(cuts):  # an added token is one word, whatever it is made of
            inside = np.searchsorted(cuts[:, 0], begin, "left") - 1
            begin = begin[(inside < 0) | (begin >= cuts[inside, 1])]
        which, words = distinct(whole, begin)
        word, at, size = words
        row = self.lexicon.rows(word, at, size)
        known = row >= 0
        new, n_new = self.vocab.merge(word, at[~known], size[~known])
        count, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        lo, hi = (self.lexicon.begin[row[known] + k].astype(np.int64) for k in (0, 1))
        count[known], count[~known] = hi - lo, n_new
        old = self.lexicon.ids[ragged(lo, hi - lo)]
        start[known] = np.cumsum(hi - lo) - (hi - lo)
        start[~known] = len(old) + np.cumsum(n_new) - n_new
        if len(cuts):
            which[np.searchsorted(begin, cuts[:, 0])] = len(at) + np.arange(len(cuts))
            start = np.concatenate([start, len(old) + len(new) + np.arange(len(cuts))])
            count = np.concatenate([count, np.ones(len(cuts), np.int64)])
        pool = np.concatenate([old, new, cuts[:, 2].astype(np.uint32)])
        n = count[which]
        total = np.concatenate([[0], np.cumsum(n)])
        per_text = total[np.searchsorted(begin, offsets)]
        return pool[ragged(start[which], n)], np.diff(per_text)


def distinct(whole: bytes, begin: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the words that begin so: the number of each one's kind, and (bytes, begin, size) of the kinds."""
    ends = np.append(begin, len(whole)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(whole)]).dictionary_encode()
    data, off = raw(words.dictionary)
    return words.indices.to_numpy().astype(np.int64), (data, off[:-1], np.diff(off))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, blob: bytes) -> Encoder:
    """One per worker process and lexicon."""
    key = (path, hash(blob))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, blob)
    return _ENCODERS[key]


# ---------------------------------------------------------------- over DataFrames
def frequent_words(docs: DataFrame, share: float = 2e-6, lexicon_size: int = 65_536) -> list[str]:
    """The commonest words of all texts, at most lexicon_size of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, floor = Counter(), 0, 0.0
        for b in pieces(batches, SLICE):
            data, off = raw(b.column("text"))
            if not len(data):
                continue
            begin = word_begins(data, off)
            which, (word, at, size) = distinct(data.tobytes(), begin)
            n, whole = np.bincount(which, minlength=len(at)), word.tobytes()
            total += len(begin)
            for i, k, m in zip(at.tolist(), size.tolist(), n.tolist(), strict=True):
                if k <= LONG:
                    seen[whole[i : i + k]] += m
            if len(seen) > 300_000:  # lossy counting: what lies under the share so far is let go
                floor = max(floor, share * total)
                seen = Counter({w: n for w, n in seen.items() if n >= floor})
        kept = [(w, n) for w, n in seen.items() if n >= share * total - floor]
        for i in range(0, len(kept), 50_000):
            part = kept[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "word").limit(lexicon_size).collect()
    return [r.word for r in top]


def build_lexicon(words: Iterable[str], path: str) -> bytes:
    raws = [w.encode() for w in words if w]
    size = np.array([len(w) for w in raws], np.int64)
    ids, n = vocabulary(path).merge(np.frombuffer(b"".join(raws), np.uint8), np.cumsum(size) - size, size)
    ends = np.cumsum(n)
    return compile_lexicon((w, ids[e - k : e]) for w, e, k in zip(raws, ends.tolist(), n.tolist(), strict=True))


def _blobs(data: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of len(size) values that lie one after another in data."""
    wide = int(size.sum()) >= 1 << 31
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64 if wide else np.int32)
    if wide:
        kind = pa.large_string() if kind == pa.string() else pa.large_binary()
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, lexicon_size: int = 65_536) -> DataFrame:
    """docs (the columns in keep, else all) with n_tokens and token_ids (little-endian u32)."""
    path = path or default_path()
    blob = build_lexicon(frequent_words(docs, lexicon_size=lexicon_size), path)
    held = docs.sparkSession.sparkContext.broadcast(blob)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "token_ids")]

    source = text_column(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoder(path, held.value)
        for b in pieces(batches, SLICE, source):
            ids, n = code(*raw(b.column(source)))
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), _blobs(ids, 4 * n, pa.binary())], [*keep, "n_tokens", "token_ids"])

    src = with_text(docs, keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])
    return src.mapInArrow(run, schema)


def _texts(vocab: Vocabulary, column: pa.Array) -> pa.Array:
    """The texts of a column of token ids."""
    data, off = raw(column)
    ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
    size = vocab.piece_size[ids]
    out = vocab.pieces[ragged(vocab.piece_begin[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[off // 4]
    at = ends[:-1][np.diff(ends) > 0]
    try:
        sound = not ((out[at] & 0xC0) == 0x80).any() and out.tobytes().decode() is not None
    except UnicodeDecodeError:
        sound = False
    if sound:  # as a whole, and no text begins inside a character
        return _blobs(out, np.diff(ends), pa.string())
    return pa.array([out[i:j].tobytes().decode("utf-8", "replace") for i, j in itertools.pairwise(ends.tolist())], pa.string())


def decode(encoded: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """encoded (the columns in keep, else all) with decoded, the text of token_ids."""
    path = path or default_path()
    keep = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in pieces(batches, SLICE, "_ids"):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], _texts(vocab, b.column("_ids"))], [*keep, "decoded"])

    src = encoded.select(*keep, F.col("token_ids").alias("_ids"))
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("decoded", T.StringType())])
    return src.mapInArrow(run, schema)
