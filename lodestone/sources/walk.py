"""References of all methods of an image at once, without decoding operands.

The code of an image lies in one array of 16-bit units.  For every unit, whether an instruction
begins there or not, a size table and the counts of payloads give where the next one would begin; which
places are reached from a method's first unit is then found by doubling: the places reached in
up to 2^k steps, and the place 2^k steps on.  The rounds are as many as the logarithm of the longest method,
each an array operation over the whole image.
"""

from __future__ import annotations

import struct

import numpy as np

from .dex import OPCODES, SIZES, CorruptImage, Image

SIZE = np.array(SIZES, np.int64)
#: Kinds of references by opcode, 0: none.
KINDS = ("", *sorted({spec.partition(":")[2] for _, spec in OPCODES.values()} - {""}))
KIND = np.array([KINDS.index(OPCODES[op][1].partition(":")[2]) if op in OPCODES else 0 for op in range(256)])
WIDE = np.array([op in OPCODES and OPCODES[op][1].startswith("31c") for op in range(256)])
NAMES = np.array([OPCODES[op][0] if op in OPCODES else f"unused-{op:02x}" for op in range(256)], object)


def code_units(img: Image) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, first, class_seq, method_seq): the units of every method with code, one after another;
    those of the i-th are first[i] to first[i + 1]."""
    data = img.whole()
    at, size, owner, place = [], [], [], []
    for k in range(len(img.class_defs)):
        for m, _, _, off in img.methods_of(k):
            if off:
                (n,) = struct.unpack_from("<I", data, off + 12)
                if off + 16 + 2 * n > len(data):
                    raise CorruptImage("code runs over the end")
                at.append(off + 16)
                size.append(n)
                owner.append(k)
                place.append(m)
    n = np.array(size, np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    byte = np.repeat(np.array(at, np.int64) - 2 * first[:-1], n) + 2 * np.arange(first[-1])
    raw = np.frombuffer(data, np.uint8)
    units = raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8
    return units, first, np.array(owner, np.int64), np.array(place, np.int64)


def following(u: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every unit the place after the instruction or payload that would begin there."""
    n = len(u)
    size = SIZE[u & 255]
    mark = np.flatnonzero(((u & 255) == 0) & (u > 0) & (u >> 8 <= 3))
    if len(mark):
        get = lambda d: u[np.minimum(mark + d, n - 1)]
        kind, count = u[mark] >> 8, get(1)
        wide = (get(2) | get(3) << 16) * count
        size[mark] = np.where(kind == 1, 4 + 2 * count, np.where(kind == 2, 2 + 4 * count, 4 + (wide + 1) // 2))
    return np.arange(n) + size


def boundaries(u: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places where an instruction or payload begins, in order."""
    n = len(u)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    after = following(u, first)
    jump = np.append(np.where(after >= end, n, after), n)  # a method's end leads nowhere
    starts = first[:-1][np.diff(first) > 0]
    reached = np.zeros(n + 1, bool)
    reached[starts] = True
    new = starts
    while len(new):
        reached[jump[np.flatnonzero(reached)]] = True
        reached[n] = False
        on = np.flatnonzero(reached)
        if len(on) == len(new):
            break
        new, jump = on, jump[jump]
    on = np.flatnonzero(reached[:n])
    if (after[on] > end[on]).any():
        raise CorruptImage("instruction runs over the end")
    return on


def references(img: Image) -> dict[str, np.ndarray]:
    """class_seq, method_seq, pc, op, ref_kind, ref_idx of every instruction that names something."""
    u, first, owner, place = code_units(img)
    on = boundaries(u, first)
    # a payload is told by the unit as a whole, which no opcode with a reference is
    op = u[on] & 255
    on, op = on[KIND[op] > 0], op[KIND[op] > 0]
    high = np.where(WIDE[op], u[np.minimum(on + 2, max(len(u) - 1, 0))] << 16 if len(u) else 0, 0)
    idx = u[on + 1] | high
    method = np.searchsorted(first, on, "right") - 1
    return {"class_seq": owner[method], "method_seq": place[method], "pc": on - first[method], "op": op, "mnemonic": NAMES[op], "ref_kind": np.array(KINDS, object)[KIND[op]], "ref_idx": idx}
