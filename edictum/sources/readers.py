"""Scans: states, N-Triples snapshots, event logs, rules, settings and contexts."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictum.sources.terms import TRIPLE, Term, term_column
from edictum.sources.turtle import parse_turtle

EVENT = T.StructType(
    [
        T.StructField("eid", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    ]
)


def resolve_path(path: str, root: str | None = None) -> str:
    """``path`` from the working folder if it is there, else from ``root``."""
    if "://" in path or os.path.isabs(path) or os.path.exists(path) or root is None:
        return path
    return str(Path(root, path))


def triples_frame(spark: SparkSession, triples: Iterable[tuple[str, str, Term]]) -> DataFrame:
    return spark.createDataFrame([(s, p, tuple(o)) for s, p, o in dict.fromkeys(triples)], TRIPLE)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    return triples_frame(spark, parse_turtle(Path(path).read_text()))


_LINE = r"^<([^>]*)> <([^>]*)> (?:<([^>]*)>|\"((?:[^\"\\]|\\.)*)\"(?:\^\^<([^>]*)>)?) \.$"


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """Triples of a frame with one canonical line a row (column ``line``)."""
    part = [F.regexp_extract("line", _LINE, i) for i in range(6)]
    text = part[4]
    for shown, raw in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
        text = F.replace(text, F.lit(shown), F.lit(raw))
    is_iri = F.col("line").rlike(r"^<[^>]*> <[^>]*> <")
    o = term_column(F.when(is_iri, "iri").otherwise("lit"), F.when(is_iri, part[3]).otherwise(text), F.nullif(part[5], F.lit("")))
    return lines.where(F.trim("line") != "").select(part[1].alias("s"), part[2].alias("p"), o.alias("o"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path).withColumnRenamed("value", "line"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log; blank lines are skipped.  Payload values keep their JSON text."""
    return spark.read.schema(EVENT).json(path)


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(folder)


def events_frame(spark: SparkSession, events: list[dict]) -> DataFrame:
    """A log of Python dictionaries; payload values become their JSON text."""

    def shown(value: object) -> str:
        return value if isinstance(value, str) else json.dumps(value)

    rows = [(e["eid"], e["timestamp"], e["type"], e.get("role"), {k: shown(v) for k, v in e.get("payload", {}).items()}) for e in events]
    return spark.createDataFrame(rows, EVENT)


def read_rules(path: str) -> list[dict]:
    return json.loads(Path(path).read_text())["rules"]


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def merged(base: dict, change: dict | None) -> dict:
    """``base`` with ``change`` laid over it, dictionaries being merged."""
    out = dict(base)
    for key, value in (change or {}).items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def governance(settings: dict, contexts: dict | None) -> dict:
    """The context a run is governed by; role ranks in the settings win over its own.

    A context that names no active roles has all ranked ones.
    """
    wanted = settings.get("governance", {})
    name = wanted.get("context_name", "default")
    found = (contexts or {}).get(name, {})
    ranks = {**found.get("role_rank", {}), **settings.get("role_precedence", {})}
    return {
        "name": name,
        "principal": found.get("principal", "automation-engine"),
        "active_roles": list(found.get("active_roles") or ranks),
        "role_rank": ranks,
        "enforce_active_roles": bool(wanted.get("enforce_active_roles", False)),
    }


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_trace(path: str) -> dict:
    return read_json(path)


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The catalog without rule texts: rid, priority, issuing_role, predicate, value_expr."""
    rows = [(r["rid"], r["priority"], r["issuing_role"], r["insert_template"]["predicate"], json.dumps(r["insert_template"]["value_expr"], sort_keys=True)) for r in rules]
    return spark.createDataFrame(rows, "rid string, priority int, issuing_role string, predicate string, value_expr string")
