"""One evaluation step: state, log, rules, settings and shapes in; decisions and the next
state out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.operators import actions, canon, resolution, windowing
from edictum.sources import readers
from edictum.sources.domain import HVAC, Domain
from edictum.sources.shared import written

SETTINGS = {
    "window": {"type": "sliding", "length_minutes": 5, "step_minutes": 1},
    "event_ordering": ["timestamp", "eid"],
    "role_precedence": {},
    "schedule_key": list(actions.SCHEDULE_KEY),
    "governance": {"context_name": "default", "enforce_active_roles": False, "conflict_policy": "first_writer_wins"},
}


@dataclass
class Step:
    """Frames of one step.  Its quads, schedule and decisions are written to the shared folder:
    each is read often, and eight rules over one written table plan faster than over its origin."""

    state: DataFrame
    events: DataFrame
    window: dict
    enabled: DataFrame
    schedule: DataFrame
    decisions: DataFrame
    successor: DataFrame
    settings: dict
    context: dict

    def summary(self) -> DataFrame:
        return self.decisions.agg(
            F.count("*").alias("scheduled_count"),
            F.count_if("accepted").alias("accepted_count"),
            F.count_if(~F.col("accepted")).alias("rejected_count"),
        )

    def digest(self) -> str:
        return canon.digest(self.successor)


def run_step(
    spark: SparkSession,
    state: DataFrame,
    events: DataFrame,
    rules: list[dict],
    constraints: list,
    settings: dict | None = None,
    contexts: dict | None = None,
    anchor: str | None = None,
    domain: Domain = HVAC,
    enforce_roles_in_resolution: bool = True,
) -> Step:
    settings = readers.merged(SETTINGS, settings)
    context = readers.governance(settings, contexts)
    chosen, window = windowing.select_window(events, settings["window"], anchor, tuple(settings["event_ordering"]))
    chosen = written(chosen, "window")
    quads = written(windowing.state_quads(state).unionByName(windowing.event_quads(chosen, domain)), "quads")
    # Written: the schedule's range partitions look at it twice.
    enabled = written(actions.enable(quads, chosen, rules, context, window["window_id"], domain), "enabled")
    scheduled = written(actions.schedule(enabled, tuple(settings["schedule_key"]), ()), "schedule")
    active = tuple(context["active_roles"]) if context["enforce_active_roles"] and enforce_roles_in_resolution else None
    options = resolution.Options(domain.gate_order, settings["governance"]["conflict_policy"], active)
    decisions = written(resolution.resolve(state, scheduled, constraints, domain, options), "decisions")
    return Step(state, chosen, window, scheduled.drop("schedule_index"), scheduled, decisions, resolution.successor(state, decisions), settings, context)
