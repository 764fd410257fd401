"""Resolution: the ordered, stateful fold of a schedule over a state.

Every action passes gates in a fixed order (role, policy, conflict, admissibility; a domain
may order them otherwise); an accepted one replaces its slot before the next is looked at.
The fold is sequential inside a component, and components run in parallel: zones where all
constraints look at their own target only and the state is admissible at the start (then
only a touched zone can become inadmissible), else one component for everything, in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.operators import canon, shacl
from edictum.sources.domain import Domain
from edictum.sources.terms import BOOLEAN, DECIMAL, Term

DECISIONS = (
    "schedule_index int, aid string, rid string, event_id string, event_role string, role string, target_key string, accepted boolean, reason string, "
    "policy_reason string, blocked_by_aid string, blocked_by_rid string, validation_report string, removed_triples array<string>, inserted_triples array<string>, "
    "s string, p string, o struct<kind:string,lex:string,dt:string,native:boolean>"
)


IN_BUCKET = 5_000  # actions


@dataclass(frozen=True)
class Options:
    gates: tuple[str, ...]
    conflict_policy: str = "first_writer_wins"
    active_roles: tuple[str, ...] | None = None  # None: the role gate passes all


def written_term(predicate: str, kind: str, lex: str, num: float | None, domain: Domain) -> Term:
    """The typed literal that a value becomes in a slot."""
    if predicate in domain.boolean_predicates:
        truth = lex.strip().lower() == "true" if kind in ("string", "bool") else bool(num)
        return Term("lit", str(truth).lower(), BOOLEAN, True)
    if predicate in domain.decimal_predicates:
        return Term("lit", repr(float(num if num is not None else lex)), DECIMAL, True)
    return Term("lit", "True" if (kind, lex) == ("bool", "true") else "False" if (kind, lex) == ("bool", "false") else lex)


def line_of(s: str, p: str, o: Term) -> str:
    if o.kind == "iri":
        return f"<{s}> <{p}> <{o.lex}> ."
    text = o.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'<{s}> <{p}> "{text}"' + (f"^^<{o.dt}>" if o.dt else "") + " ."


def guard(predicate: str, num: float | None, role: str, policy: dict, domain: Domain) -> tuple[bool, str]:
    """The policy node's bounds on a proposed value."""
    if predicate != domain.guarded or num is None or role not in domain.capped_roles:
        return True, "policy_guard_not_applicable"
    low = policy.get(domain.minimum)
    if low is not None and num < low:
        return False, f"{domain.minimum_reason}:{num} < {float(low)}"
    high = policy.get(f"{domain.base}{role}{domain.maximum}")
    if high is not None and num > high:
        return False, f"policy_role_cap_violation:{role}:{num} > {float(high)}"
    return True, "policy_guard_passed"


def fold(actions: list[dict], graph: dict, policy: dict, constraints: list, domain: Domain, options: Options, scoped: bool) -> list[dict]:
    """Decisions for one component; ``graph`` (subject -> predicate -> terms) is changed."""
    winners: dict = {}
    out = []
    for a in actions:
        d = dict.fromkeys(("blocked_by_aid", "blocked_by_rid", "validation_report", "policy_reason", "s", "p", "o"))
        d |= {k: a[k] for k in ("schedule_index", "aid", "rid", "event_id", "event_role", "role", "target_key")}
        d |= {"accepted": False, "reason": "admissible", "removed_triples": [], "inserted_triples": []}
        out.append(d)
        refused = False
        for gate in options.gates:
            if gate == "role" and options.active_roles is not None and a["role"] not in options.active_roles:
                d["reason"] = "inactive_role"
            elif gate == "policy":
                passed, d["policy_reason"] = guard(a["predicate"], a["num"], a["role"], policy, domain)
                if not passed:
                    d["reason"] = d["policy_reason"]
            elif gate == "conflict" and options.conflict_policy == "first_writer_wins" and a["target_key"] in winners:
                d["reason"] = "shadowed_by_prior_accepted_action"
                d["blocked_by_aid"], d["blocked_by_rid"] = winners[a["target_key"]]
            if d["reason"] != "admissible":
                refused = True
                break
        if refused:
            continue
        zone, predicate = a["zone"], a["predicate"]
        slots = graph.setdefault(zone, {})
        before, term = slots.get(predicate, []), written_term(predicate, a["kind"], a["lex"], a["num"], domain)
        slots[predicate] = [term]
        if "admissibility" in options.gates:
            found = shacl.faults(graph, constraints, {zone} if scoped else None)
            if found:
                slots[predicate] = before
                d["reason"], d["validation_report"] = "inadmissible", "\n".join(sorted(found))
                d |= {"s": zone, "p": predicate, "o": tuple(term)}  # what it would have written
                continue
        winners.setdefault(a["target_key"], (a["aid"], a["rid"]))
        old, new = {line_of(zone, predicate, t) for t in before}, line_of(zone, predicate, term)
        d |= {"accepted": True, "removed_triples": sorted(old - {new}), "inserted_triples": sorted({new} - old), "s": zone, "p": predicate, "o": tuple(term)}
    return out


def graph_of(rows: list[tuple]) -> dict:
    graph: dict = {}
    for s, p, kind, lex, dt in rows:
        graph.setdefault(s, {}).setdefault(p, []).append(Term(kind, lex, dt))
    return graph


def policy_values(state: DataFrame, domain: Domain) -> dict:
    """Predicate -> number of the policy node's slots (one node's triples)."""
    node = domain.base + "Policy"
    rows = state.where((F.col("s") == node) & F.col("o")["dt"].isNotNull()).select("p", F.col("o")["lex"].try_cast("double")).collect()
    return {p: v for p, v in rows if v is not None}


def components(constraints: list, admissible: bool) -> str:
    return "zone" if admissible and all(c.local for c in constraints) else "global"


def resolve(state: DataFrame, scheduled: DataFrame, constraints: list, domain: Domain, options: Options | None = None, mode: str | None = None) -> DataFrame:
    """One decision per scheduled action.

    ``mode`` is ``zone`` or ``global``; chosen from the constraints and the state if not given.
    """
    options = options or Options(domain.gate_order)
    if mode is None:
        mode = components(constraints, shacl.violations(state, constraints).isEmpty()) if constraints else "zone"
    policy = policy_values(state, domain)
    # Independent zones are dealt to buckets of some thousand actions; a bucket folds zone by zone.
    buckets = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), scheduled.count() // IN_BUCKET + 1) if mode == "zone" else 1

    def bucket(name: str):
        return F.pmod(F.xxhash64(name), F.lit(buckets))

    todo = scheduled.select(
        bucket("zone").alias("c"), "schedule_index", "aid", "rid", "event_id", "event_role", "role", "target_key", "zone", "predicate",
        F.col("value")["kind"].alias("kind"), F.col("value")["lex"].alias("lex"), F.col("value")["num"].alias("num"),
    )
    graph = state
    if mode == "zone":
        graph = graph.join(scheduled.select(F.col("zone").alias("s")).distinct(), "s", "left_semi")
    graph = graph.select(bucket("s").alias("c"), "s", "p", F.col("o")["kind"].alias("kind"), F.col("o")["lex"].alias("lex"), F.col("o")["dt"].alias("dt"))
    names = [x.split()[0] for x in DECISIONS.split(", ")]
    for c in constraints:
        if c.select is not None:
            c.query()  # parsed here, once, and not by every worker

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("schedule_index")
        acts = [{k: (None if v is None or v != v else v) for k, v in a.items()} for a in left.drop(columns="c").to_dict("records")]
        held = graph_of([(s, p, k, x, None if d is None or d != d else d) for s, p, k, x, d in right[["s", "p", "kind", "lex", "dt"]].itertuples(index=False)])
        if mode != "zone":
            return pd.DataFrame(fold(acts, held, policy, constraints, domain, options, False), columns=names)
        by_zone: dict = {}
        for a in acts:
            by_zone.setdefault(a["zone"], []).append(a)
        done = [d for zone, mine in by_zone.items() for d in fold(mine, {zone: held[zone]} if zone in held else {}, policy, constraints, domain, options, True)]
        return pd.DataFrame(done, columns=names)

    return todo.groupBy("c").cogroup(graph.groupBy("c")).applyInPandas(run, DECISIONS)


def successor(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state after the accepted writes (the last of each slot)."""
    last = decisions.where("accepted").groupBy("s", "p").agg(F.max_by("o", "schedule_index").alias("o"))
    return canon.apply_writes(state, last)


def last_writer_wins(state: DataFrame, ordered: DataFrame, domain: Domain) -> DataFrame:
    """All writes applied in order and nothing checked: the last of each slot stays."""
    v = F.max_by("value", "schedule_index")
    rows = ordered.groupBy(F.col("zone").alias("s"), F.col("predicate").alias("p")).agg(v.alias("v"))
    truth = F.when(F.col("v.kind").isin("string", "bool"), F.lower(F.trim("v.lex")) == "true").otherwise(F.col("v.num") != 0)
    o = (
        F.when(F.col("p").isin(*domain.boolean_predicates) if domain.boolean_predicates else F.lit(False), F.struct(F.lit("lit").alias("kind"), truth.cast("string").alias("lex"), F.lit(BOOLEAN).alias("dt"), F.lit(True).alias("native")))
        .when(F.col("p").isin(*domain.decimal_predicates), F.struct(F.lit("lit").alias("kind"), F.col("v.num").cast("string").alias("lex"), F.lit(DECIMAL).alias("dt"), F.lit(True).alias("native")))
        .otherwise(F.struct(F.lit("lit").alias("kind"), F.col("v.lex").alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(False).alias("native")))
    )
    return canon.apply_writes(state, rows.select("s", "p", o.alias("o")))
