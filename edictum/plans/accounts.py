"""The engine's model over the driver's tables: customers are entities, events the log.

Slots of an entity: ``balance`` (cents, clamped into range so that the start is admissible),
``segment``, ``locked``.  Roles follow the event type.  Eight rules propose writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANK = {"emergency": 0, "operator": 1, "occupant": 2}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "LOCKED", "OFF")
TOP, OFF_TOP, LEAST = 1_000_000, 500_000, 1_000
CAPS = {"occupant": 400_000, "operator": 800_000, "emergency": 900_000}
SLOTS = {"balance": "bigint", "segment": "string", "locked": "boolean"}
ORDER = ["role_rank", "priority", "ts_key", "rid", "aid"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("zone"),
        F.least(F.greatest(cents(F.col("c_acctbal")), F.lit(0)), F.lit(TOP - 1)).alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.lit(False).alias("locked"),
    )


def role_of(kind: Column) -> Column:
    return F.when(kind == "error", "emergency").when(kind.isin("purchase", "signup"), "operator").otherwise("occupant")


def rank_of(role: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])[role], F.lit(999))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        F.col("user_id").alias("zone"),
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_key"),
        cents(F.col("value")).alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        role_of(F.col("event_type")).alias("role"),
    )


#: rid, event type, priority, slot, condition, value.
RULES = (
    ("r1", "click", 2, "balance", "true", "balance + cents"),
    ("r2", "purchase", 1, "balance", "true", "cents * 10"),
    ("r3", "signup", 1, "segment", "true", "'HOUSEHOLD'"),
    ("r4", "view", 2, "balance", "NOT locked", "balance + 100"),
    ("r5", "error", 1, "locked", "cents > 3000", "true"),
    ("r6", "error", 0, "segment", "cents > 6000", "'LOCKED'"),
    ("r7", "purchase", 1, "balance", "k > 50", "k * 10000"),
    ("r8", "purchase", 1, "segment", "k <= 50", "'OFF'"),
)


def enabled(events: DataFrame, state: DataFrame) -> DataFrame:
    """Actions of all rules: one pass over the log joined with the state, no union of scans."""
    rows = events.join(state, "zone")
    kinds = {"balance": "bigint", "segment": "string", "locked": "boolean"}

    def action(rid: str, kind: str, priority: int, slot: str, condition: str, value: str) -> Column:
        to = [(F.expr(value) if s == slot else F.lit(None)).cast(t).alias(f"to_{s}") for s, t in kinds.items()]
        made = F.struct(F.lit(rid).alias("rid"), F.lit(priority).alias("priority"), F.lit(slot).alias("slot"), *to)
        return F.when((F.col("event_type") == kind) & F.expr(condition), made)

    rows = rows.withColumn("a", F.explode(F.filter(F.array(*[action(*r) for r in RULES]), lambda a: a.isNotNull())))
    bind = F.concat(F.lit('{"cents":'), F.col("cents").cast("string"), F.lit(',"eid":"'), F.col("event_id").cast("string"), F.lit('","zone":"'), F.col("zone").cast("string"), F.lit('"}'))
    rows = rows.select("zone", "event_id", "ts_key", "role", rank_of(F.col("role")).alias("role_rank"), "a.*", bind.alias("bind_key"))
    aid = F.sha2(F.concat(F.lit('{"bindings":'), F.col("bind_key"), F.lit(',"rid":"'), F.col("rid"), F.lit('","slot":"'), F.col("slot"), F.lit('"}')), 256)
    return rows.withColumn("aid", aid).withColumn("refused", guard()).withColumn("id", F.col("aid"))


def guard() -> Column:
    """The policy gate, of the action alone: reason or null."""
    cap = F.create_map(*[x for k, v in CAPS.items() for x in (F.lit(k), F.lit(v))])[F.col("role")]
    value = F.col("to_balance")
    return (
        F.when(F.col("slot") != "balance", None)
        .when(value < LEAST, F.concat(F.lit("policy_min_violation:"), value.cast("string"), F.lit(f" < {LEAST}")))
        .when(value > cap, F.concat(F.lit("policy_role_cap_violation:"), F.col("role"), F.lit(":"), value.cast("string"), F.lit(" > "), cap.cast("string")))
    )


def admissible(s: dict[str, Column]) -> Column:
    return (
        s["balance"].between(0, TOP)
        & s["segment"].isin(*SEGMENTS)
        & (~s["locked"] | (s["segment"] == "LOCKED"))
        & ((s["segment"] != "OFF") | (s["balance"] <= OFF_TOP))
    )
