"""Generated states and event logs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.functions.values import stable_json
from edictum.operators import canon
from edictum.sources.domain import BUILDING
from edictum.sources.readers import triples_frame
from edictum.sources.terms import BOOLEAN, DECIMAL, RDF_TYPE, Term, iri, term_column


POLICY = {"occupantMaxSetpoint": "23.0", "operatorMaxSetpoint": "24.0", "emergencyMaxSetpoint": "26.0", "minSetpoint": "18.0"}


def zone_state(spark: SparkSession, n: int, base: str = BUILDING, policy: dict[str, str] | None = None, name: str = "ScaleZone%05d") -> DataFrame:
    """``n`` zones of six triples each, and one policy node."""
    policy = POLICY if policy is None else policy
    slots = (
        (RDF_TYPE, "iri", base + "HVAC_Zone", None, False),
        (base + "currentSetpoint", "lit", "20.0", DECIMAL, False),
        (base + "occupied", "lit", "false", BOOLEAN, False),
        (base + "co2Level", "lit", "500.0", DECIMAL, False),
        (base + "ventilationMode", "lit", "normal", None, False),
        (base + "emergencyState", "lit", "false", BOOLEAN, False),
    )
    made = F.array(*[F.struct(F.lit(p).alias("p"), term_column(k, F.lit(lex), dt, native).alias("o")) for p, k, lex, dt, native in slots])
    zones = spark.range(n).select(F.format_string(base + name, "id").alias("s"), F.explode(made).alias("t")).select("s", "t.p", "t.o")
    held = [F.struct(F.lit(RDF_TYPE).alias("p"), term_column("iri", F.lit(base + "ControlPolicy")).alias("o"))]
    held += [F.struct(F.lit(base + k).alias("p"), term_column("lit", F.lit(v), DECIMAL).alias("o")) for k, v in policy.items()]
    node = spark.range(1).select(F.lit(base + "Policy").alias("s"), F.explode(F.array(*held)).alias("t")).select("s", "t.p", "t.o")
    return zones.union(node)


def tied_state(spark: SparkSession, base: str = BUILDING) -> DataFrame:
    """The zone that tied actions write, and a policy that lets them."""
    zone, policy = base + "SynthZone", base + "Policy"
    rows = [(zone, RDF_TYPE, iri(base + "HVAC_Zone")), (policy, RDF_TYPE, iri(base + "ControlPolicy"))]
    rows += [(zone, base + p, Term("lit", lex, dt)) for p, lex, dt in (("currentSetpoint", "20.0", DECIMAL), ("ventilationMode", "normal", None), ("emergencyState", "false", BOOLEAN), ("occupied", "true", BOOLEAN), ("co2Level", "500", DECIMAL))]
    rows += [(policy, base + p, Term("lit", lex, DECIMAL)) for p, lex in (("occupantMaxSetpoint", "26"), ("operatorMaxSetpoint", "26"), ("emergencyMaxSetpoint", "26"), ("minSetpoint", "18"))]
    return triples_frame(spark, rows)


def tied_actions(spark: SparkSession, n: int, base: str = BUILDING) -> DataFrame:
    """``n`` actions on one slot that differ in rule, binding and identity only; values go round
    from 18 to 26."""
    zone, predicate = base + "SynthZone", base + "currentSetpoint"
    bind = F.concat(F.lit('{"i":'), F.col("id").cast("string"), F.lit("}"))
    rid, eid = F.format_string("r_synth_%04d", "id"), F.format_string("synth-evt-%04d", "id")
    amount = (18 + F.col("id") % 9).cast("double")
    quoted = {"bindings": bind, "eid": F.concat(F.lit('"'), eid, F.lit('"')), "predicate": F.lit(f'"{predicate}"'), "rid": F.concat(F.lit('"'), rid, F.lit('"')), "window_id": F.lit('"urn:window"')}
    return spark.range(n).select(
        F.sha2(stable_json(quoted), 256).alias("aid"), rid.alias("rid"), F.concat(F.lit("urn:event:"), eid).alias("event_uri"), eid.alias("event_id"), F.lit("2026-03-14T09:00:00Z").alias("event_ts"),
        F.lit("operator").alias("event_role"), F.lit("urn:window").alias("window_id"), F.lit(zone).alias("zone"), F.lit(predicate).alias("predicate"), F.lit(f"{zone}|{predicate}").alias("target_key"),
        F.struct(F.lit("number").alias("kind"), amount.cast("string").alias("lex"), amount.alias("num")).alias("value"),
        F.lit(1).alias("priority"), F.lit("operator").alias("role"), F.lit(1).alias("roleRank"), F.lit(0).cast("long").alias("tsKey"), bind.alias("bindKey"),
    )


def primed(state: DataFrame, slots: list[tuple[str, str, Term]]) -> DataFrame:
    """``state`` with some slots set otherwise."""
    return canon.apply_writes(state, triples_frame(state.sparkSession, slots))


def requests(
    spark: SparkSession,
    n: int,
    kind: str = "PreheatRequest",
    key: str = "target",
    value: str = "22",
    role: str = "operator",
    one_target: bool = False,
    every_second: str | None = None,
    base: str = BUILDING,
    name: str = "ScaleZone%05d",
) -> DataFrame:
    """``n`` events of one type, each for its own zone or all for the first; every second
    one has the value ``every_second`` where that is given."""
    amount = F.when(F.col("id") % 2 == 1, F.lit(every_second)).otherwise(F.lit(value)) if every_second else F.lit(value)
    zone = F.format_string(base + name, F.lit(0).cast("long") if one_target else F.col("id"))
    return spark.range(n).select(
        F.format_string("scale-preheat-%05d", "id").alias("eid"),
        F.lit("2026-03-14T09:00:00Z").alias("timestamp"),
        F.lit(kind).alias("type"),
        F.lit(role).alias("role"),
        F.create_map(F.lit("zone"), zone, F.lit(key), amount).alias("payload"),
    )
