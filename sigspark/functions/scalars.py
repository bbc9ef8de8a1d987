"""Scalar helpers: integer arithmetic, key parts, octets, text fields, literals, formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def key_parts(key: Column, *radices: int) -> list[Column]:
    """Parts of a packed integer key, first part first: key_parts(k, 1000, 10000) splits off two lower levels."""
    out = []
    for r in reversed(radices):
        out.append(key % r)
        key = quotient(key, r)
    return [key, *reversed(out)]


def key_join(parts: list[Column], *radices: int) -> Column:
    key = parts[0]
    for p, r in zip(parts[1:], radices):
        key = key * r + p
    return key


def octets(address: Column) -> Column:
    """A dotted quad as a number, first octet lowest; null unless it is four numbers of 0..255."""
    p = F.split(address, r"\.")
    n = [F.get(p, i).try_cast("int") for i in range(4)]
    ok = F.size(p) == 4
    for x in n:
        ok = ok & F.coalesce(x.between(0, 255), F.lit(False))
    return F.when(ok, sum((x.cast("bigint") * 256**i for i, x in enumerate(n)), F.lit(0)))


def field(line: Column, i: int, kind: str = "string", sep: str = r"\|") -> Column:
    """The i-th field of a text line; null if it is missing or malformed."""
    x = F.trim(F.get(F.split(line, sep), i))
    return F.nullif(x, F.lit("")) if kind == "string" else x.try_cast(kind)


_ESCAPES = {"n": 10, "t": 9, "r": 13, "b": 8, "f": 12, "v": 11, "a": 7, "\\": 92, "'": 39, '"': 34, "?": 63}


def char_literal(text: str) -> int:
    """Code of a character literal: a character, an escape, or an octal or hexadecimal code."""
    t = text.strip() if len(text) > 1 else text
    if len(t) >= 3 and t[0] == t[-1] == "'":
        t = t[1:-1]
    if len(t) == 1:
        return ord(t)
    if m := re.fullmatch(r"\\x([0-9a-fA-F]{1,2})", t):
        return int(m[1], 16)
    if m := re.fullmatch(r"\\([0-7]{1,3})", t):
        if int(m[1], 8) < 256:
            return int(m[1], 8)
    elif len(t) == 2 and t[0] == "\\" and t[1] in _ESCAPES:
        return _ESCAPES[t[1]]
    raise ValueError(f"{text!r} is not a character")


def formatted(pattern: str, *columns: Column) -> Column:
    """printf over columns: %d %u %ld %lld %f %e %g %x %c %s with flags, width and precision."""
    java = re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)(?:ll|l|h)?([duifegxcs])", lambda m: f"%{m[1]}{'d' if m[2] in 'ui' else m[2]}", pattern)
    return F.format_string(java, *columns)
