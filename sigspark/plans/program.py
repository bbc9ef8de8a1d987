"""Typed program parameters from one-letter switches and positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

_MISSING = object()
INTEGERS = {"char": 8, "short": 16, "int": 32, "long": 64, "long long": 64}


class UsageError(SystemExit):
    def __init__(self, message: str):
        super().__init__(2)
        self.message = message

    def __str__(self) -> str:
        return self.message


@dataclass(frozen=True)
class Param:
    """switch None: by position. kind: a name of convert(), 'flag', or a callable that opens a store from text and mode."""

    name: str
    kind: str | Callable[[str, str], Any] = "string"
    switch: str | None = None
    default: Any = _MISSING
    help: str = ""
    mode: str = "either"


def convert(kind: str, text: str) -> Any:
    """Text to a value of a C kind, with range and format checks."""
    try:
        if kind == "string":
            return text
        if kind == "char":
            from ..functions.scalars import char_literal

            return char_literal(text)
        if kind in INTEGERS:
            value, bits = int(text.strip(), 0), INTEGERS[kind]
            if not -(1 << (bits - 1)) <= value < 1 << (bits - 1):
                raise UsageError(f"{text} is out of range for {kind}")
            return value
        if kind in ("float", "double"):
            value = float(text.strip())
            if kind == "float" and value == value and abs(value) not in (float("inf"),) and abs(value) > 3.4028235e38:
                raise UsageError(f"{text} is out of range for float")
            return value
    except ValueError:
        raise UsageError(f"{text!r} is not a {kind}") from None
    raise UsageError(f"{kind} cannot be given on the command line")


def usage(program: str, params: Sequence[Param]) -> str:
    parts = [f"[-{p.switch}{'' if p.kind == 'flag' else ' ' + p.name}]" if p.switch else p.name for p in params]
    return " ".join([f"usage: {program}", *parts])


def bind(params: Sequence[Param], argv: Sequence[str]) -> dict[str, Any]:
    """Values by name. argv[0] is the program; it binds the first parameter if that has no switch."""
    program, *rest = argv
    switches = {p.switch: p for p in params if p.switch}
    if len(switches) < sum(1 for p in params if p.switch):
        raise ValueError("a switch is declared twice")
    out: dict[str, Any] = {}
    positions = [p for p in params if not p.switch]
    if params and not params[0].switch:
        out[params[0].name] = program
        positions = positions[1:]
    values: list[str] = []
    at = 0
    while at < len(rest):
        word = rest[at]
        at += 1
        if word == "--":
            raise UsageError(usage(program, params))
        if len(word) < 2 or word[0] != "-" or word[1].isdigit():
            values.append(word)
            continue
        p = switches.get(word[1])
        if not p:
            raise UsageError(f"unknown option {word}\n{usage(program, params)}")
        if p.name in out:
            raise UsageError(f"option -{p.switch} is repeated")
        if p.kind == "flag":
            out[p.name] = True
            continue
        text = word[2:]
        if not text:
            if at == len(rest):
                raise UsageError(f"option -{p.switch} needs an argument")
            text = rest[at]
            at += 1
        out[p.name] = _value(p, text)
    if len(values) > len(positions):
        raise UsageError(f"too many arguments\n{usage(program, params)}")
    for p, text in zip(positions, values):
        out[p.name] = _value(p, text)
    for p in params:
        if p.name not in out:
            if p.kind == "flag":
                out[p.name] = bool(p.default) if p.default is not _MISSING else False
            elif p.default is _MISSING:
                raise UsageError(f"{p.name} is missing\n{usage(program, params)}")
            else:
                out[p.name] = p.default
    return out


def _value(p: Param, text: str) -> Any:
    return p.kind(text, p.mode) if callable(p.kind) else convert(p.kind, text)
