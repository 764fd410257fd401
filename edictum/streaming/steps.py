"""Step composition: each step's state is the next one's start.

Batch (``run_anchors``): a driver loop over anchors.  Streaming (``stream_steps``): every
micro-batch of the log is a step, committed under its batch id, so that a repeated batch
changes nothing.  Delivery is ``redelivery`` (an event fires in every window that holds it)
or ``consume_once`` (a ledger of event ids is anti-joined).  Late events, those whose windows
had run before they arrived, are reported, not silently dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edictum.operators import windowing
from edictum.plans.engine import Step, run_step
from edictum.sources.domain import HVAC, Domain
from edictum.sources.store import StepStore


def arrived(events: DataFrame, step_number: int, arrival: str = "arrival_step") -> DataFrame:
    """Events that have arrived by a step; without the column all have."""
    return events.where(F.coalesce(F.col(arrival), F.lit(0)) <= step_number) if arrival in events.columns else events


def run_anchors(
    spark: SparkSession, state: DataFrame, events: DataFrame, anchors: list[str], rules: list[dict], constraints: list,
    settings: dict, contexts: dict | None, store: StepStore, mode: str = "redelivery", domain: Domain = HVAC,
) -> list[Step]:
    """One step per anchor; states and the ledger go through the store."""
    steps, ledger = [], None
    for i, anchor in enumerate(anchors):
        log = arrived(events, i)
        if mode == "consume_once" and ledger is not None:
            log = log.join(ledger, "eid", "left_anti")
        step = run_step(spark, state, log, rules, constraints, settings, contexts, anchor, domain)
        state = store.commit_state(step.successor, step.decisions, f"anchor-{i:05d}")
        if mode == "consume_once":
            # What an accepted action has used up; written, so that plans don't nest.
            used = store.decisions(f"anchor-{i:05d}").where("accepted").select(F.col("event_id").alias("eid"))
            ledger = store.keep(used if ledger is None else used.union(ledger), f"ledger-{i:05d}").distinct()
        steps.append(step)
    return steps


def late(events: DataFrame, anchors: list[str], length_minutes: int, arrival: str = "arrival_step") -> DataFrame:
    """Events that no window saw after they had arrived."""
    spark = events.sparkSession
    numbered = spark.createDataFrame(list(enumerate(anchors)), "step int, a string").select("step", windowing.parse_instant(F.col("a")).alias("anchor"))
    seen = windowing.window_join(windowing.with_instants(events), numbered, length_minutes).where(F.coalesce(F.col(arrival), F.lit(0)) <= F.col("step"))
    return events.join(seen.select("eid").distinct(), "eid", "left_anti")


def stream_steps(
    events: DataFrame, state: DataFrame, rules: list[dict], constraints: list, settings: dict, contexts: dict | None,
    store: StepStore, checkpoint: str, domain: Domain = HVAC, on_step: Callable[[int, Step], None] | None = None, mode: str = "redelivery",
) -> StreamingQuery:
    """A streaming log resolved micro-batch by micro-batch; start with ``availableNow``.

    A batch's window ends at its latest event.  Events of the batch that are older than the window
    are kept as ``late-<batch>`` in the store, before the step is committed; with ``consume_once``
    the ids that a step's accepted actions used are kept as ``used-<batch>``.  Both are written
    under the batch's name, so a repeated batch writes them again and changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        name = f"batch-{number:09d}"
        if store.has(name) or batch.isEmpty():
            return
        spark = batch.sparkSession
        log = batch
        if mode == "consume_once":
            ledger = store.kept(spark, "used-*", "eid string")
            log = log.join(ledger, "eid", "left_anti")
        now = store.current_state(spark)
        done = run_step(spark, state if now is None else now, log, rules, constraints, settings, contexts, None, domain)
        store.keep(batch.join(done.events.select("eid"), "eid", "left_anti").join(log.select("eid"), "eid", "left_semi"), f"late-{name}")
        if mode == "consume_once":
            store.keep(done.decisions.where("accepted").select(F.col("event_id").alias("eid")).distinct(), f"used-{name}")
        store.commit_state(done.successor, done.decisions, name)
        if on_step:
            on_step(number, done)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str, lateness: str) -> DataFrame:
    """A streaming aggregate of the log by type with a watermark."""
    log = events.withColumn("ts", windowing.parse_instant(F.col("timestamp"))).withWatermark("ts", lateness)
    return log.groupBy(F.window("ts", length), "type").agg(F.count("*").alias("n"))
