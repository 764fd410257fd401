"""Expressions of conditions, over columns and over one solution in memory.

An expression is a variable, a term, or a tuple: an operator with its operands, or
``("call", name, arguments)``.  Its value is a term; an error is no value.  Products and quotients
are to six decimals.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from edictum.sources.terms import BOOLEAN, DECIMAL, INTEGER, NUMERIC, Term, number, term_column


@dataclass(frozen=True)
class Var:
    name: str


COMPARED = ("=", "!=", "<", ">", "<=", ">=")
SIX = Decimal("0.000001")


# --- over columns ---------------------------------------------------------------------


def constant(t: Term) -> Column:
    return term_column(t.kind, F.lit(t.lex), t.dt)


def same(column: Column, t: Term) -> Column:
    """Equality of terms: kind, lexical form and datatype."""
    return (column["kind"] == t.kind) & (column["lex"] == t.lex) & column["dt"].eqNullSafe(F.lit(t.dt))


def _equal(a: Column, b: Column) -> Column:
    x, y = number(a), number(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(x.isNotNull() & y.isNotNull(), x == y).otherwise((a["kind"] == b["kind"]) & (a["lex"] == b["lex"]) & a["dt"].eqNullSafe(b["dt"]))


def _known(test: Column, made: Column) -> Column:
    """A term, or none where its lexical form is null."""
    return F.when(test.isNotNull(), made)


def _made(column: Column, kind: str | None) -> Column:
    return _known(column, term_column("lit", column, kind, kind is not None))


def _number(e) -> Column:
    """The number of an expression, without a term around each step: terms are structs of
    several uses of it, so nested ones would grow with a power of the depth."""
    if isinstance(e, tuple) and not isinstance(e, Term):
        if e[0] == "neg":
            return -_number(e[1])
        if e[0] in ("+", "-", "*", "/"):
            x, y = _number(e[1]), _number(e[2])
            made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: F.round(x * y, 6), "/": lambda: F.when(y != 0, F.round(x.cast("double") / y.cast("double"), 6).cast("decimal(38,6)"))}[e[0]]()
            return made.cast("decimal(38,10)")
        if e[0] == "call" and e[1] in ROUNDED:
            return ROUNDED[e[1]][0](_number(e[2][0])).cast("decimal(38,10)")
        if e[0] == "call" and e[1] in PARTS:
            return F.regexp_extract(_lexical(e[2][0]), PARTS[e[1]], 1).try_cast("decimal(38,10)")
        if e[0] == "call" and e[1] == "STRLEN":
            return F.length(_lexical(e[2][0])).cast("decimal(38,10)")
        if e[0] == "call" and e[1] == "IF":
            return F.when(condition(e[2][0]), _number(e[2][1])).otherwise(_number(e[2][2]))
    return number(value(e))


def _lexical(e) -> Column:
    """The lexical form of an expression, as ``_number``."""
    if isinstance(e, tuple) and not isinstance(e, Term) and e[0] == "call":
        if e[1] == "STR":
            return _lexical(e[2][0])
        if e[1] == "CONCAT":
            return F.concat(*map(_lexical, e[2]))
        if e[1] in TEXTS:
            return TEXTS[e[1]][0](_lexical(e[2][0]))
        if e[1] == "SUBSTR":
            return F.substring(_lexical(e[2][0]), _number(e[2][1]).cast("int"), _number(e[2][2]).cast("int") if len(e[2]) > 2 else F.lit(1 << 30))
    return value(e)["lex"]


def value(e) -> Column:
    if isinstance(e, Var):
        return F.col(e.name)
    if isinstance(e, Term):
        return constant(e)
    if e[0] == "call" and e[1] not in TESTS:
        args = e[2]
        if e[1] == "COALESCE":
            return F.coalesce(*map(value, args))
        if e[1] == "IF":
            return F.when(condition(args[0]), value(args[1])).otherwise(value(args[2]))
        if e[1] == "DATATYPE":
            found = value(args[0])["dt"]
            return _known(found, term_column("iri", found))
        if e[1] in ("STR", "CONCAT", "SUBSTR") or e[1] in TEXTS:
            return _made(_lexical(e), None)
        if e[1] == "STRLEN":
            return _made(F.length(_lexical(args[0])), INTEGER)
        return _made(_number(e), DECIMAL)
    if e[0] in ("neg", "+", "-", "*", "/"):
        return _made(_number(e), DECIMAL)
    test = condition(e)
    return _known(test, term_column("lit", test.cast("string"), BOOLEAN, True))


def condition(e) -> Column:
    """Whether an expression is true; null where it has no value."""
    if isinstance(e, tuple) and not isinstance(e, Term):
        if e[0] == "!":
            return ~condition(e[1])
        if e[0] in ("&&", "||"):
            left, right = condition(e[1]), condition(e[2])
            return left & right if e[0] == "&&" else left | right
        if e[0] == "in":
            return reduce(lambda x, y: x | y, [_equal(value(e[1]), value(t)) for t in e[2]], F.lit(False))
        if e[0] in COMPARED:
            a, b = value(e[1]), value(e[2])
            x, y = number(a), number(b)
            numeric = {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e[0]]
            equal = (a["kind"] == b["kind"]) & (a["lex"] == b["lex"]) & a["dt"].eqNullSafe(b["dt"])
            text = {"=": equal, "!=": ~equal}.get(e[0], F.lit(None).cast("boolean"))
            # Of an unbound variable nothing is true or false.
            return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(x.isNotNull() & y.isNotNull(), numeric).otherwise(text)
        if e[0] == "call" and e[1] in TESTS:
            if e[1] == "BOUND":
                return value(e[2][0]).isNotNull()
            if e[1] == "REGEX":
                flag = "(?i)" if len(e[2]) > 2 and "i" in e[2][2].lex else ""
                return value(e[2][0])["lex"].rlike(flag + e[2][1].lex)
            return TESTS[e[1]][0](*map(value, e[2]))
    found = value(e)
    return found["lex"] == "true"


# --- in memory ------------------------------------------------------------------------


def as_number(t: Term | None) -> Decimal | None:
    if t is None or t.kind != "lit" or t.dt not in NUMERIC:
        return None
    try:
        return Decimal(t.lex)
    except InvalidOperation:
        return None


def _literal(found, kind: str | None = None) -> Term | None:
    return None if found is None else Term("lit", str(found), kind, kind is not None)


def evaluate(e, row: dict) -> Term | None:
    if isinstance(e, Var):
        return row.get(e.name)
    if isinstance(e, Term):
        return e
    if e[0] == "call" and e[1] not in TESTS:
        if e[1] == "COALESCE":
            return next((t for t in (evaluate(a, row) for a in e[2]) if t is not None), None)
        if e[1] == "IF":
            return evaluate(e[2][1 if holds(e[2][0], row) else 2], row)
        args = [evaluate(a, row) for a in e[2]]
        if None in args:
            return None
        if e[1] == "STR":
            return _literal(args[0].lex)
        if e[1] == "DATATYPE":
            return Term("iri", args[0].dt) if args[0].dt else None
        if e[1] == "CONCAT":
            return _literal("".join(a.lex for a in args))
        if e[1] == "SUBSTR":
            start = int(as_number(args[1])) - 1
            return _literal(args[0].lex[start : start + int(as_number(args[2])) if len(args) > 2 else None])
        if e[1] in TEXTS:
            return _literal(TEXTS[e[1]][1](args[0].lex))
        if e[1] in PARTS:
            found = re.search(PARTS[e[1]], args[0].lex)
            return _literal(Decimal(found[1]) if found else None, DECIMAL)
        if e[1] == "STRLEN":
            return _literal(len(args[0].lex), INTEGER)
        n = as_number(args[0])
        return _literal(None if n is None else ROUNDED[e[1]][1](n), DECIMAL)
    if e[0] == "neg":
        n = as_number(evaluate(e[1], row))
        return _literal(None if n is None else -n, DECIMAL)
    if e[0] in ("+", "-", "*", "/"):
        x, y = as_number(evaluate(e[1], row)), as_number(evaluate(e[2], row))
        if x is None or y is None or (e[0] == "/" and not y):
            return None
        return _literal({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: (x * y).quantize(SIX), "/": lambda: (x / y).quantize(SIX)}[e[0]](), DECIMAL)
    found = holds(e, row)
    return None if found is None else Term("lit", str(found).lower(), BOOLEAN, True)


def holds(e, row: dict) -> bool | None:
    if isinstance(e, tuple) and not isinstance(e, Term):
        if e[0] == "!":
            found = holds(e[1], row)
            return None if found is None else not found
        if e[0] in ("&&", "||"):
            both = [holds(x, row) for x in e[1:]]
            decisive = e[0] == "||"
            return decisive if decisive in both else None if None in both else not decisive
        if e[0] == "in":
            tests = [holds(("=", e[1], t), row) for t in e[2]]
            return True if True in tests else None if None in tests else False
        if e[0] in COMPARED:
            a, b = (evaluate(x, row) for x in e[1:])
            x, y = as_number(a), as_number(b)
            if x is not None and y is not None:
                return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e[0]]
            if a is None or b is None or e[0] not in ("=", "!="):
                return None
            return (a[:3] == b[:3]) == (e[0] == "=")
        if e[0] == "call" and e[1] in TESTS:
            args = [evaluate(a, row) for a in e[2]]
            if e[1] == "BOUND":
                return args[0] is not None
            if None in args:
                return None
            if e[1] == "REGEX":
                flags = re.IGNORECASE if len(args) > 2 and "i" in args[2].lex else 0
                return bool(re.search(args[1].lex, args[0].lex, flags))
            return TESTS[e[1]][1](*args)
    found = evaluate(e, row)
    return None if found is None else found.lex == "true"


TEXTS = {
    "UCASE": (F.upper, str.upper),
    "LCASE": (F.lower, str.lower),
    "MD5": (F.md5, lambda t: hashlib.md5(t.encode()).hexdigest()),
    "SHA1": (F.sha1, lambda t: hashlib.sha1(t.encode()).hexdigest()),
    "SHA256": (lambda c: F.sha2(c, 256), lambda t: hashlib.sha256(t.encode()).hexdigest()),
}
PARTS = {
    "YEAR": r"^(-?\d{4,})-", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)",
    "HOURS": r"T(\d\d):", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)",
}
ROUNDED = {
    "ABS": (F.abs, abs),
    "CEIL": (F.ceil, lambda n: n.to_integral_value("ROUND_CEILING")),
    "FLOOR": (F.floor, lambda n: n.to_integral_value("ROUND_FLOOR")),
    "ROUND": (lambda c: F.floor(c + F.lit(Decimal("0.5"))), lambda n: (n + Decimal("0.5")).to_integral_value("ROUND_FLOOR")),
}
TESTS = {
    "BOUND": None,
    "REGEX": None,
    "CONTAINS": (lambda a, b: a["lex"].contains(b["lex"]), lambda a, b: b.lex in a.lex),
    "STRSTARTS": (lambda a, b: a["lex"].startswith(b["lex"]), lambda a, b: a.lex.startswith(b.lex)),
    "STRENDS": (lambda a, b: a["lex"].endswith(b["lex"]), lambda a, b: a.lex.endswith(b.lex)),
    "ISIRI": (lambda a: a["kind"] == "iri", lambda a: a.kind == "iri"),
    "ISLITERAL": (lambda a: a["kind"] == "lit", lambda a: a.kind == "lit"),
    "ISNUMERIC": (lambda a: number(a).isNotNull(), lambda a: as_number(a) is not None),
}
FUNCTIONS = {"COALESCE", "IF", "STR", "DATATYPE", "CONCAT", "SUBSTR", "STRLEN", *TEXTS, *PARTS, *ROUNDED, *TESTS}
