"""Typed terms and triples.

A triple is a row (s, p, o): subject and predicate are IRIs; the object is a struct of
kind (``iri`` or ``lit``), lexical form, datatype IRI (null for plain strings) and
``native``, true where a number was made from a machine number rather than parsed from
text.  Identity is lexical: ``22`` and ``22.0`` are different terms.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
DECIMAL, BOOLEAN, INTEGER, DOUBLE = (XSD + n for n in ("decimal", "boolean", "integer", "double"))
NUMERIC = (DECIMAL, INTEGER, DOUBLE, XSD + "float")

TERM = "struct<kind:string,lex:string,dt:string,native:boolean>"
TRIPLE = f"s string, p string, o {TERM}"


class Term(NamedTuple):
    kind: str
    lex: str
    dt: str | None = None
    native: bool = False


def iri(value: str) -> Term:
    return Term("iri", value)


def lit(value: object) -> Term:
    """A literal of a Python value, as a machine number where it is one."""
    if isinstance(value, bool):
        return Term("lit", str(value).lower(), BOOLEAN, True)
    if isinstance(value, int):
        return Term("lit", str(value), INTEGER, True)
    if isinstance(value, float):
        return Term("lit", repr(value), DECIMAL, True)
    return Term("lit", str(value))


def term_column(kind: Column | str, lex: Column, dt: Column | str | None = None, native: Column | bool = False) -> Column:
    def as_column(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        as_column(kind).cast("string").alias("kind"),
        lex.cast("string").alias("lex"),
        as_column(dt).cast("string").alias("dt"),
        as_column(native).cast("boolean").alias("native"),
    )


def n3_line(s: Column, p: Column, o: Column) -> Column:
    """The canonical line of a triple."""
    text = o["lex"]
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(o["dt"].isNotNull(), F.concat(F.lit("^^<"), o["dt"], F.lit(">"))).otherwise(""))
    shown = F.when(o["kind"] == "iri", F.concat(F.lit("<"), o["lex"], F.lit(">"))).otherwise(literal)
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), shown, F.lit(" ."))


def number(o: Column) -> Column:
    """The term's value as a decimal, null where it has none."""
    return F.when((o["kind"] == "lit") & o["dt"].isin(*NUMERIC), o["lex"].try_cast("decimal(38,10)"))
