"""Values, JSON texts and identities of actions, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from edictum.sources.terms import BOOLEAN, DECIMAL, NUMERIC


def json_text(value: Column) -> Column:
    """A string as JSON, ASCII only."""
    quoted = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"^\{\"v\":|\}$", "")

    def unit(number: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(number)), 4, "0"))

    def shown(c: Column) -> Column:
        point = F.ascii(c)
        rest = point - 0x10000  # beyond the basic plane: a pair of surrogates
        pair = F.concat(unit(F.shiftright(rest, 10) + 0xD800), unit(rest.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(point > 0xFFFF, pair).when(point > 127, unit(point)).otherwise(c)

    escaped = F.array_join(F.transform(F.split(quoted, ""), shown), "")
    return F.when(quoted.rlike(r"[^\x00-\x7F]"), escaped).otherwise(quoted)


def json_term(o: Column) -> Column:
    """A bound term as JSON: parsed decimals are strings, machine numbers numbers."""
    bare = (o["dt"] == BOOLEAN) | (o["dt"].isin(*NUMERIC) & (o["native"] | (o["dt"] != DECIMAL)))
    return F.when(F.coalesce(bare, F.lit(False)), o["lex"]).otherwise(json_text(o["lex"]))


def stable_json(fields: dict[str, Column]) -> Column:
    """A JSON object of JSON texts, keys sorted, no blanks."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + json.dumps(key) + ":"), fields[key]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


VALUE = "struct<kind:string,lex:string,num:double>"


def _value(kind: str | Column, lex: Column, num: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), lex.cast("string").alias("lex"), num.cast("double").alias("num"))


def action_value(expr: dict) -> Column:
    """The value a rule writes; unknown kinds are refused while the plan is built."""
    kind = (expr or {}).get("kind")
    if kind == "copy":
        o = F.col(expr["var"])
        number = F.coalesce(o["dt"].isin(*NUMERIC), F.lit(False))
        tag = F.when(number, "number").when(F.coalesce(o["dt"] == BOOLEAN, F.lit(False)), "bool").otherwise("string")
        return _value(tag, o["lex"], F.when(number, o["lex"].try_cast("double")))
    if kind == "literal":
        v = expr["value"]
        if isinstance(v, bool):
            return _value("bool", F.lit(str(v).lower()), F.lit(None))
        if isinstance(v, (int, float)):
            return _value("integer" if isinstance(v, int) else "number", F.lit(repr(v)), F.lit(float(v)))
        return _value("string", F.lit(str(v)), F.lit(None))
    if kind in ("numeric_add", "numeric_add_constant"):
        left = F.col(expr["left" if kind == "numeric_add" else "var"])["lex"].cast("double")
        right = F.col(expr["right"])["lex"].cast("double") if kind == "numeric_add" else F.lit(float(expr["constant"]))
        return _value("number", (left + right).cast("string"), left + right)
    raise ValueError(f"unsupported value expression: {kind!r}")
