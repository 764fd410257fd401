"""Event-time windows at anchors, and events as quads.

Sliding windows are closed at both ends; tumbling ones are aligned to their step and
half open; anything else selects the whole log.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.operators.ordering import numbered
from edictum.sources.domain import Domain
from edictum.sources.terms import BOOLEAN, DECIMAL, INTEGER, RDF_TYPE, term_column

WINDOW_GRAPH, STATE_GRAPH = "urn:window", "urn:state"
PROPERTY = "urn:prop:"


def parse_instant(text: Column) -> Column:
    """ISO-8601 text as a timestamp; without a zone it is UTC (the session's zone)."""
    return F.try_to_timestamp(F.trim(text))


def with_instants(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", parse_instant(F.col("timestamp"))).withColumn("ts_key", F.coalesce(F.unix_micros("ts"), F.lit(0)))


def iso(micros: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)).isoformat()


def iso_column(ts: Column) -> Column:
    """The same text as ``iso``: a fraction only where there is one."""
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def tumbling_bounds(micros: Column | int, length: int, step: int):
    """Start and end, in microseconds, of the aligned window at an anchor."""
    width = max(1, step) * 60_000_000
    if isinstance(micros, int):
        end = (micros // width + 1) * width
    else:
        end = (F.floor(micros / width) + 1) * width
    return end - length * 60_000_000, end


def select_window(events: DataFrame, window: dict, anchor: str | None = None, ordering: tuple[str, ...] = ("timestamp", "eid")) -> tuple[DataFrame, dict]:
    """The events of one window with their ``ordinal``, and the window's description."""
    log = with_instants(events)
    if anchor is not None:
        at = log.sparkSession.range(1).select(F.unix_micros(parse_instant(F.lit(anchor)))).first()[0]
    else:
        at = log.agg(F.max("ts_key")).first()[0]
    kind = window.get("type", "sliding")
    if at is None:
        return log.limit(0).withColumn("ordinal", F.lit(0)), {"window_type": kind, "window_id": "empty", "window_start": None, "window_end": None, "anchor_timestamp": None}
    length, step = int(window.get("length_minutes", 5)), int(window.get("step_minutes", 1))
    if kind == "sliding":
        start, end = at - length * 60_000_000, at
        chosen = log.where(F.col("ts_key").between(start, end))
    elif kind == "tumbling":
        start, end = tumbling_bounds(at, length, step)
        chosen = log.where((F.col("ts_key") >= start) & (F.col("ts_key") < end))
    else:
        start, end = log.agg(F.min("ts_key"), F.max("ts_key")).first()
        chosen = log  # "single" as well, whose id doesn't name its bounds
    order = [F.col("ts_key") if k == "timestamp" else F.col(k) for k in ordering]
    chosen = numbered(chosen, order, "ordinal")
    empty = chosen.isEmpty()
    shown = {"window_type": kind, "window_start": iso(start), "window_end": iso(end), "anchor_timestamp": iso(at)}
    named = window.get("window_id", "single-window") if kind == "single" else f"{kind}:{iso(start)}::{iso(end)}"
    return chosen, shown | {"window_id": "empty" if empty else named}


def window_join(events: DataFrame, anchors: DataFrame, length_minutes: int) -> DataFrame:
    """Events (with ``ts``) against every anchor whose closed window holds them.

    A range join made an equi-join: time is cut into cells of the window's length, an event
    can only fall in the windows of anchors of its own cell and the next.
    """
    width = length_minutes * 60_000_000
    cells = anchors.withColumn("_a", F.unix_micros("anchor")).withColumn("_cell", F.explode(F.array(F.floor(F.col("_a") / width), F.floor(F.col("_a") / width) - 1)))
    log = events.withColumn("_t", F.unix_micros("ts")).withColumn("_cell", F.floor(F.col("_t") / width))
    return log.join(cells, "_cell").where((F.col("_t") <= F.col("_a")) & (F.col("_t") >= F.col("_a") - width)).drop("_cell", "_a", "_t")


def payload_term(key: Column, value: Column, domain: Domain) -> Column:
    """The literal that a payload entry becomes."""
    number = value.try_cast("double")
    flag = F.lower(F.trim(value)) == "true"
    return (
        F.when(key.isin(*domain.iri_keys), term_column("iri", value))
        .when(key.isin(*domain.boolean_keys) if domain.boolean_keys else F.lit(False), term_column("lit", flag, BOOLEAN, True))
        .when(key.isin(*domain.numeric_keys) & number.isNotNull(), term_column("lit", number.cast("string"), DECIMAL, True))
        .when(value.rlike(r"^-?\d+$"), term_column("lit", value, INTEGER, True))
        .otherwise(term_column("lit", value))
    )


def event_quads(chosen: DataFrame, domain: Domain) -> DataFrame:
    """Each event of a window as quads: its fields, its ordinal, and its payload."""
    s = F.concat(F.lit("urn:event:"), "eid")
    fixed = [F.struct(F.lit(k).alias("k"), term_column("lit", F.col(k)).alias("o")) for k in ("eid", "timestamp", "type", "role")]
    fixed.append(F.struct(F.lit("order").alias("k"), term_column("lit", F.col("ordinal"), INTEGER, True).alias("o")))
    payload = F.transform(F.map_entries(F.coalesce("payload", F.create_map())), lambda e: F.struct(e["key"].alias("k"), payload_term(e["key"], e["value"], domain).alias("o")))
    rows = chosen.select(s.alias("s"), F.explode(F.concat(F.array(*fixed), payload)).alias("e"))
    return rows.where(F.col("e.o.lex").isNotNull()).select(F.lit(WINDOW_GRAPH).alias("g"), "s", F.concat(F.lit(PROPERTY), "e.k").alias("p"), "e.o")


def state_quads(state: DataFrame) -> DataFrame:
    """A state as quads; its numbers count as parsed, however they were made."""
    o = F.col("o")
    return state.select(F.lit(STATE_GRAPH).alias("g"), "s", "p", term_column(o["kind"], o["lex"], o["dt"]).alias("o"))


def typed_nodes(state: DataFrame, cls: str) -> DataFrame:
    return state.where((F.col("p") == RDF_TYPE) & (F.col("o")["lex"] == cls)).select("s")
