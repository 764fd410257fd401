"""Traces: a step as tables and as one document, replay, and comparison."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.operators import actions, canon, resolution
from edictum.plans.engine import Step, run_step
from edictum.sources import readers
from edictum.sources.domain import HVAC, Domain

VERSION = "2.1"


def tables(step: Step) -> dict[str, DataFrame]:
    """The frames that make up a trace."""
    return {
        "events": step.events.select("eid", "timestamp", "type", "role", "payload"),
        "enabled": step.enabled,
        "schedule": step.schedule,
        "decisions": step.decisions,
        "accepted": step.decisions.where("accepted"),
        "graph_in": canon.lines(step.state),
        "graph_out": canon.lines(step.successor),
        "summary": step.enabled.agg(F.count("*").alias("enabled_count")).crossJoin(step.summary()),
    }


def write_tables(step: Step, folder: str) -> None:
    for name, frame in tables(step).items():
        frame.write.mode("errorifexists").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = ("events", "enabled", "schedule", "decisions", "accepted", "graph_in", "graph_out", "summary")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def document(step: Step, rules: list[dict], digests: bool = False) -> dict:
    """One JSON document of the whole step, for export.  Small steps only: it is gathered."""

    def rows(frame: DataFrame, *order: str) -> list[dict]:
        return [json.loads(r[0]) for r in frame.orderBy(*order).select(F.to_json(F.struct(*frame.columns))).collect()]

    def graph(state: DataFrame) -> dict:
        return canon.snapshot(state).first().asDict()

    decided = step.decisions.drop("s", "p", "o")
    if digests:
        decided = decided.join(canon.digests_along(step.state, step.decisions), "schedule_index")
    found = rows(decided, "schedule_index")
    return {
        "trace_version": VERSION,
        "settings": step.settings,
        "window": step.window | {"governance_context": step.context},
        "rules": [{k: r.get(k) for k in ("rid", "priority", "issuing_role", "insert_template")} for r in rules],
        "events": rows(tables(step)["events"], "timestamp", "eid"),
        "input_graph": graph(step.state),
        "enabled_actions": rows(step.enabled, "aid"),
        "schedule": rows(step.schedule, "schedule_index"),
        "accepted_actions": [d for d in found if d["accepted"]],
        "decisions": found,
        "successor_graph": graph(step.successor),
        "summary": {"enabled_count": len(found), "scheduled_count": len(found), "accepted_count": sum(d["accepted"] for d in found), "rejected_count": sum(not d["accepted"] for d in found)},
    }


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text file anywhere Spark can write; complete or not there under its name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    beside, target = hadoop.Path(path + ".tmp"), hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def write_document(spark: SparkSession, found: dict, path: str) -> None:
    """A trace document (or other results) as JSON, keys sorted."""
    write_text(spark, path, json.dumps(found, indent=2, sort_keys=True))


def write_rows(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Results as CSV, one line each, in the order of the first one's keys."""
    held = io.StringIO()
    writer = csv.DictWriter(held, list(rows[0]) if rows else [], lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    write_text(spark, path, held.getvalue())


def reason_class(reason):
    """A reason without the figures in it."""
    return F.when(reason.startswith("policy_"), F.regexp_extract(reason, "^(policy_[a-z_]+)", 1)).otherwise(reason)


def differences(recorded: DataFrame, again: DataFrame, columns: tuple[str, ...], at: str = "schedule_index") -> DataFrame:
    """Places where two runs differ, with both sides; a full outer join by place."""
    left = recorded.select(at, F.struct(*columns).alias("recorded"))
    right = again.select(at, F.struct(*columns).alias("regenerated"))
    return left.join(right, at, "full").where(~F.col("recorded").eqNullSafe(F.col("regenerated")))


def first_difference(found: DataFrame, at: str = "schedule_index"):
    return found.orderBy(at).first()


def compare(recorded: dict[str, DataFrame], again: dict[str, DataFrame]) -> dict:
    """Five axes of a full replay, and the first difference of the decisions."""
    enabled = recorded["enabled"].select("aid").exceptAll(again["enabled"].select("aid")).union(again["enabled"].select("aid").exceptAll(recorded["enabled"].select("aid"))).isEmpty()
    schedule = differences(recorded["schedule"], again["schedule"], ("aid",)).isEmpty()
    changed = differences(recorded["decisions"], again["decisions"], ("aid", "accepted", "reason", "target_key"))
    first = first_difference(changed)
    accepted = differences(recorded["accepted"], again["accepted"], ("aid",)).isEmpty()
    digest = recorded["graph_out"].agg(canon.digest_column()).first()[0] == again["graph_out"].agg(canon.digest_column()).first()[0]
    axes = {"enabled": enabled, "schedule": schedule, "decisions": first is None, "accepted": accepted, "digest": digest}
    return axes | {"overall_pass": all(axes.values()), "first_difference": first.asDict(True) if first else None}


def replay_full(spark: SparkSession, recorded: dict[str, DataFrame], rules: list[dict], constraints: list, settings: dict, contexts: dict | None, anchor: str, domain: Domain = HVAC) -> dict:
    """Everything again from the recorded events and input graph, compared on five axes.

    The role gate is off in replay; roles were already looked at when rules were enabled.
    """
    state = readers.parse_ntriples(recorded["graph_in"])
    step = run_step(spark, state, recorded["events"], rules, constraints, settings, contexts, anchor, domain, enforce_roles_in_resolution=False)
    return compare(recorded, tables(step))


def replay_state(recorded: dict[str, DataFrame], constraints: list, domain: Domain = HVAC) -> dict:
    """Accepted writes applied again in order, each looked at by the constraints again.

    Raises where one is refused now.  Recorded digests of decisions (columns pre_ and
    post_graph_digest, where there are any) and of the final state are compared.
    """
    state = readers.parse_ntriples(recorded["graph_in"])
    accepted = recorded["decisions"].where("accepted")
    again = resolution.resolve(state, recorded["schedule"].join(accepted.select("aid"), "aid", "left_semi"), constraints, domain, resolution.Options(("admissibility",)))
    refused = again.where(~F.col("accepted")).orderBy("schedule_index").first()
    if refused is not None:
        raise ValueError(f"accepted action {refused.aid} is inadmissible on replay:\n{refused.validation_report}")
    after = canon.digest(resolution.successor(state, again))
    steps = True
    if "post_graph_digest" in recorded["decisions"].columns:
        sides = ("pre_graph_digest", "post_graph_digest")
        along = canon.digests_along(state, again).select("schedule_index", *sides)
        steps = differences(accepted, along, sides).isEmpty()
    expected = recorded["graph_out"].agg(canon.digest_column()).first()[0]
    return {"accepted_action_count": accepted.count(), "step_digest_match": steps, "successor_digest_match": after == expected, "replay_successor_digest": after}


def order_only_outcome(step: Step, seed: int | None, domain: Domain = HVAC) -> DataFrame:
    """The state when all writes are applied unchecked, in the schedule's order or a random one."""
    ordered = step.schedule if seed is None else actions.random_order(step.enabled, seed)
    return resolution.last_writer_wins(step.state, ordered, domain)
