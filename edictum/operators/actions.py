"""Rule enablement, content-addressed actions, and their total order."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edictum.functions.values import action_value, json_term, json_text, stable_json
from edictum.operators import sparql
from edictum.operators.ordering import numbered
from edictum.sources.domain import Domain

SCHEDULE_KEY = ("roleRank", "priority", "tsKey", "rid", "bindKey", "aid")
UNRANKED = 999


def _rule_actions(quads: DataFrame, rule: dict, roles: DataFrame, window_id: str, ranks: dict, active: list | None, domain: Domain) -> DataFrame:
    query = sparql.parse(rule["condition_select"])
    rows = sparql.to_frame(quads, query, bag=False)
    names = [n for n, _ in query.columns]
    predicate = rule["insert_template"]["predicate"]
    subject = dict(domain.subject_by_predicate).get(predicate, domain.subject_var)
    bindings = {n: json_term(F.col(n)) for n in names if n != "e"}
    uri = F.col("e")["lex"]
    eid = F.coalesce(F.nullif(F.col("eid")["lex"], F.lit("")), F.element_at(F.split(uri, ":"), -1)) if "eid" in names else F.element_at(F.split(uri, ":"), -1)
    issuing = rule["issuing_role"]
    made = rows.select(
        uri.alias("event_uri"), eid.alias("event_id"), F.col(subject)["lex"].alias("zone"),
        action_value(rule["insert_template"]["value_expr"]).alias("value"),
        stable_json(bindings).alias("bindKey"),
    ).join(roles, "event_uri", "left")
    made = made.where(F.col("event_role").isNull() | (F.col("event_role") == issuing))
    if active is not None:
        made = made.where(F.coalesce(F.col("event_role").isin(active), F.lit(True)))
    identity = {"rid": F.lit(json.dumps(rule["rid"])), "eid": json_text(F.col("event_id")), "window_id": F.lit(json.dumps(window_id)), "predicate": F.lit(json.dumps(predicate)), "bindings": F.col("bindKey")}
    return made.select(
        F.sha2(stable_json(identity), 256).alias("aid"), F.lit(rule["rid"]).alias("rid"), "event_uri", "event_id", "event_ts", "event_role",
        F.lit(window_id).alias("window_id"), "zone", F.lit(predicate).alias("predicate"), F.concat_ws("|", "zone", F.lit(predicate)).alias("target_key"),
        "value", F.lit(int(rule["priority"])).alias("priority"), F.lit(issuing).alias("role"), F.lit(int(ranks.get(issuing, UNRANKED))).alias("roleRank"),
        F.coalesce("ts_key", F.lit(0)).alias("tsKey"), "bindKey",
    )


def enable(quads: DataFrame, chosen: DataFrame, rules: list[dict], context: dict, window_id: str, domain: Domain) -> DataFrame:
    """All actions that the rules allow in a window, one row per ``aid``."""
    active = context["active_roles"] if context["enforce_active_roles"] else None
    roles = chosen.select(F.concat(F.lit("urn:event:"), "eid").alias("event_uri"), F.col("role").alias("event_role"), F.col("timestamp").alias("event_ts"), "ts_key").dropDuplicates(["event_uri"])
    parts = [_rule_actions(quads, r, roles, window_id, context["role_rank"], active, domain) for r in rules if active is None or r["issuing_role"] in active]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["aid"])


def schedule(actions: DataFrame, key: tuple[str, ...] = SCHEDULE_KEY, within: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """``schedule_index``: places in the total order, inside each window (``within``)."""
    missing = [k for k in key if k not in actions.columns]
    if missing:
        raise KeyError(missing[0])
    if not within:  # one window only: no task should sort all of it
        return numbered(actions, [F.col(k) for k in key], "schedule_index")
    return actions.withColumn("schedule_index", F.row_number().over(Window.partitionBy(*within).orderBy(*key)) - 1)


def random_order(actions: DataFrame, seed: int, within: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """A seeded order that looks at nothing but the action's identity."""
    return actions.withColumn("schedule_index", F.row_number().over(Window.partitionBy(*within).orderBy(F.xxhash64(F.lit(seed), "aid"), "aid")) - 1)


def tie_random_order(actions: DataFrame, seed: int, prefix: tuple[str, ...] = SCHEDULE_KEY[:3], within: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """The total order's prefix, ties in a seeded order."""
    return actions.withColumn("schedule_index", F.row_number().over(Window.partitionBy(*within).orderBy(*prefix, F.xxhash64(F.lit(seed), "aid"), "aid")) - 1)
