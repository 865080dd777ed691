"""Names, descriptors and predicates over them, as native column expressions.

Literals are prepared in Python (normalisation), columns stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java identifiers that can't be used as names (fixed values of the language).
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _"
).split()

PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


# ---------------------------------------------------------------- literals
def normalize_type(name: str) -> str:
    """a.b.C, a/b/C and La/b/C; all mean La/b/C;."""
    name = name.strip().replace(".", "/")
    return name if name.startswith("L") and name.endswith(";") else f"L{name};"


def normalize_prefix(prefix: str, sep: str = ".") -> str:
    """Slashes and dots become sep, separators at the end go."""
    return prefix.strip().replace("/", sep).replace(".", sep).rstrip(sep)


def class_literal(name: str) -> str:
    """Internal name a/b/C of any spelling."""
    return normalize_type(name)[1:-1]


# ---------------------------------------------------------------- predicates
def contains(col: Column, needle: str) -> Column:
    """Case-sensitive literal substring; an empty needle is in everything."""
    return F.contains(col, F.lit(needle))


def fold(col: Column) -> Column:
    """ASCII letters in lower case, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ignoring_case(col: Column, needle: str) -> Column:
    """Substring under ASCII case folding."""
    return F.contains(fold(col), F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle)))


def any_label(col: Column, patterns: list[str]) -> Column:
    """The image filter: any pattern, ignoring ASCII case, anywhere in the label; no pattern lets all through."""
    out = F.lit(not patterns)
    for p in patterns:
        out = out | contains_ignoring_case(col, p)
    return out


def under_prefix(col: Column, prefix: str, sep: str = ".") -> Column:
    """The prefix itself or anything below it, by whole segments."""
    return F.lit(True) if not prefix else (col == prefix) | col.startswith(prefix + sep)


def owner_is(col: Column, name: str | None, fuzzy: bool = False) -> Column:
    """Owner-class predicate on an internal name: equal, or substring if fuzzy."""
    if name is None:
        return F.lit(True)
    return contains(col, name.replace(".", "/")) if fuzzy else col == class_literal(name)


# ---------------------------------------------------------------- renderings
def class_name(descriptor: Column) -> Column:
    """La/b/C; -> a/b/C (one L only); anything else unchanged."""
    return F.when(descriptor.startswith("L") & descriptor.endswith(";"), F.substring(descriptor, F.lit(2), F.length(descriptor) - 2)).otherwise(descriptor)


def dotted(name: Column) -> Column:
    return F.translate(name, "/", ".")


def proto(params: Column, returns: Column) -> Column:
    """(params)ret."""
    return F.concat(F.lit("("), F.array_join(params, ""), F.lit(")"), returns)


def method_ref(cls: Column, name: Column, desc: Column) -> Column:
    return F.concat(cls, F.lit("->"), name, desc)


def field_ref(cls: Column, name: Column, type_: Column) -> Column:
    return F.concat(cls, F.lit("->"), name, F.lit(":"), type_)


def quoted(col: Column) -> Column:
    """A double-quoted literal with the usual escapes; other control characters by number."""
    out = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {0: "\\0", 9: "\\t", 10: "\\n", 13: "\\r"}
    shown = out
    for code in (*range(0x20), *range(0x7F, 0xA0)):
        shown = F.replace(shown, F.lit(chr(code)), F.lit(short.get(code, f"\\u{{{code:x}}}")))
    # few texts have any: the long chain runs on those alone
    return F.concat(F.lit('"'), F.when(col.rlike("[\\x00-\\x1f\\x7f-\\x9f]"), shown).otherwise(out), F.lit('"'))


def resolve_name(package: Column, name: Column) -> Column:
    """A component's name against its package: .X and X without a dot are relative."""
    return F.when(name.startswith("."), F.concat(package, name)).when(~F.contains(name, F.lit(".")) & (F.length(name) > 0), F.concat(package, F.lit("."), name)).otherwise(name)


def human_size(n: Column) -> Column:
    """Bytes as text: whole below a KB, else with one digit (ties to even) in KB, MB or GB."""
    shown = lambda unit, k: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1 << k)), 1))
    return F.when(n >= 1 << 30, shown("GB", 30)).when(n >= 1 << 20, shown("MB", 20)).when(n >= 1 << 10, shown("KB", 10)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def digest(col: Column) -> Column:
    """MD5 of a text or of bytes, as hexadecimal digits."""
    return F.md5(col.cast("binary"))


def flags(access: Column, mask: int) -> Column:
    """The access flags inside a mask."""
    return access.bitwiseAND(mask)


def java_identifier(name: str) -> str:
    """A legal identifier for any name: what no identifier may hold becomes `_`; keywords, a first
    digit and a lone `_` get one in front.  Different names can become equal (`operators.names` tells them apart)."""
    out = "".join(c if c in "_$" or (c.isascii() and c.isalnum()) else "_" for c in name) or "_"
    return f"_{out}" if out in JAVA_KEYWORDS or out == "_" or out[0].isdigit() else out


def java_type(descriptor: str) -> str:
    """How source text spells a descriptor."""
    depth = len(descriptor) - len(descriptor.lstrip("["))
    base = descriptor[depth:]
    base = PRIMITIVES.get(base, base[1:-1].replace("/", ".") if base.startswith("L") else base)
    return base + "[]" * depth
