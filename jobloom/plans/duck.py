"""Small builders of DuckDB SQL for the equivalents of the queries."""

from __future__ import annotations

from collections.abc import Iterable

SP = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def m(x: str, p: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {q(p)}, {q(flags)})" if flags else f"regexp_matches({x}, {q(p)})"


def anym(x: str, ps: Iterable[str], flags: str = "i") -> str:
    return m(x, "|".join(f"(?:{p})" for p in ps), flags)


def has(x: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def hits(x: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")"


def rep(x: str, p: str, r: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(p)}, {q(r)}, {q(flags)})"


def trim(x: str) -> str:
    return rep(x, f"^{SP}+|{SP}+$", "")


def squeeze(x: str) -> str:
    return f"trim({rep(x, SP + '+', ' ')}, ' ')"


def us(x: str) -> str:
    return f"epoch_us({x})"
