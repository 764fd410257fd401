"""Queries that run the rule engine's own modules over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edictum.operators import actions, canon, resolution, shacl, sparql, windowing
from edictum.plans import accounts, cases, trace
from edictum.plans.registry import query
from edictum.sources import readers
from edictum.sources.shared import shared_dir, written
from edictum.sources.store import Crash, StepStore
from edictum.sources.terms import BOOLEAN, DECIMAL, INTEGER, RDF_TYPE
from edictum.streaming import steps

DAY = 86_400_000_000


def _iso(micros: str) -> str:
    return f"(strftime(make_timestamp({micros}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} % 1000000 <> 0 THEN '.' || lpad(CAST({micros} % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00')"


ZONES = """zones AS (SELECT 'urn:zone:' || c_custkey AS zone, CAST(least(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0), 999999) AS DOUBLE) AS balance,
  c_mktsegment AS segment, false AS locked FROM customer)"""
LOG = """log AS (SELECT 'evt-' || event_id AS eid, 'urn:zone:' || user_id AS zone, event_type, epoch_us(ts) AS ts_key,
  CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS cents, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS DOUBLE) AS k,
  CASE WHEN event_type = 'error' THEN 'emergency' WHEN event_type IN ('purchase', 'signup') THEN 'operator' ELSE 'occupant' END AS role FROM events)"""
WINDOW = f"win AS (SELECT max(ts_key) AS w1, max(ts_key) - {cases.DAYS * DAY} AS w0 FROM log), recent AS (SELECT log.* FROM log, win WHERE ts_key BETWEEN w0 AND w1), wid AS (SELECT 'sliding:' || {_iso('w0')} || '::' || {_iso('w1')} AS window_id FROM win)"
RULES = """rules(rid, kind, priority, issuing, slot) AS (VALUES ('r1','click',2,'occupant','balance'),('r2','purchase',1,'operator','balance'),('r3','signup',1,'operator','segment'),
  ('r4','view',2,'occupant','balance'),('r5','error',1,'emergency','locked'),('r6','error',0,'emergency','segment'),('r7','purchase',1,'operator','balance'),('r8','purchase',1,'operator','segment'))"""


def _enabled_sql(recent: str = "recent", zones: str = "zones", wid: str = "wid", made: str = "enabled") -> str:
    return f"""{made}_0 AS (SELECT l.eid, l.zone, l.ts_key, l.role, rid, priority, slot, window_id, CASE l.role WHEN 'emergency' THEN 0 WHEN 'operator' THEN 1 ELSE 2 END AS role_rank,
    CASE rid WHEN 'r1' THEN balance + cents WHEN 'r2' THEN cents WHEN 'r4' THEN balance + 100 WHEN 'r7' THEN cents + k END AS num,
    CASE rid WHEN 'r3' THEN 'HOUSEHOLD' WHEN 'r5' THEN 'true' WHEN 'r6' THEN 'LOCKED' WHEN 'r8' THEN 'OFF' END AS word,
    '{{' || CASE rid WHEN 'r1' THEN '"balance":"' || balance || '","cents":' || cents || ',' WHEN 'r2' THEN '"cents":' || cents || ',' WHEN 'r4' THEN '"balance":"' || balance || '",'
      WHEN 'r5' THEN '"cents":' || cents || ',' WHEN 'r6' THEN '"cents":' || cents || ',' WHEN 'r7' THEN '"cents":' || cents || ',' ELSE '' END
      || '"eid":"' || eid || '",' || CASE WHEN rid IN ('r7', 'r8') THEN '"k":' || k || ',' ELSE '' END || '"zone":"' || l.zone || '"}}' AS bind_key
  FROM {recent} l JOIN {zones} z ON l.zone = z.zone JOIN rules ON kind = event_type, {wid}
  WHERE CASE rid WHEN 'r4' THEN NOT locked WHEN 'r5' THEN cents > 3000 WHEN 'r6' THEN cents > 6000 WHEN 'r7' THEN k > 50 WHEN 'r8' THEN k <= 50 ELSE true END),
{made} AS (SELECT *, sha256('{{"bindings":' || bind_key || ',"eid":"' || eid || '","predicate":"urn:acc:' || slot || '","rid":"' || rid || '","window_id":"' || window_id || '"}}') AS aid,
    CASE WHEN slot <> 'balance' THEN 'policy_guard_not_applicable' WHEN num < 1000 THEN 'policy_min_violation:' || num || ' < 1000.0'
      WHEN num > CASE role WHEN 'operator' THEN 800000 ELSE 400000 END THEN 'policy_role_cap_violation:' || role || ':' || num || ' > ' || CASE role WHEN 'operator' THEN '800000.0' ELSE '400000.0' END
      ELSE 'policy_guard_passed' END AS policy_reason,
    coalesce(CAST(num AS VARCHAR), word) AS shown FROM {made}_0)"""


ORDER = "role_rank, priority, ts_key, rid, bind_key, aid"


def _fold_sql(enabled: str = "enabled", zones: str = "zones", made: str = "fold") -> str:
    """The step's fold as a recursive CTE, one step per place in a zone's schedule."""
    return f"""{made}_todo AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {ORDER}) AS i FROM {enabled}),
{made} AS (
  SELECT z.zone, CAST(0 AS BIGINT) AS i, balance, segment, locked, CAST(NULL AS VARCHAR) AS bb, CAST(NULL AS VARCHAR) AS bs, CAST(NULL AS VARCHAR) AS bl,
         CAST(NULL AS VARCHAR) AS aid, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS blocker, CAST(NULL AS VARCHAR) AS eid, CAST(NULL AS VARCHAR) AS rid, CAST(NULL AS VARCHAR) AS slot
  FROM {zones} z WHERE zone IN (SELECT zone FROM {made}_todo)
  UNION ALL
  SELECT zone, i, CASE WHEN reason = 'admissible' THEN nb ELSE balance END, CASE WHEN reason = 'admissible' THEN ns ELSE segment END, CASE WHEN reason = 'admissible' THEN nl ELSE locked END,
         CASE WHEN reason = 'admissible' AND slot = 'balance' THEN aid ELSE bb END, CASE WHEN reason = 'admissible' AND slot = 'segment' THEN aid ELSE bs END,
         CASE WHEN reason = 'admissible' AND slot = 'locked' THEN aid ELSE bl END, aid, reason, CASE WHEN reason LIKE 'shadowed%' THEN blocked END, eid, rid, slot
  FROM (SELECT *, CASE WHEN policy_reason LIKE '%violation%' THEN policy_reason WHEN blocked IS NOT NULL THEN 'shadowed_by_prior_accepted_action'
                       WHEN nb BETWEEN 0 AND 1000000 AND (NOT nl OR ns = 'LOCKED') AND (ns <> 'OFF' OR nb <= 500000) THEN 'admissible' ELSE 'inadmissible' END AS reason
        FROM (SELECT f.zone, t.i, f.balance, f.segment, f.locked, bb, bs, bl, t.aid, t.slot, t.policy_reason, t.eid, t.rid, CASE t.slot WHEN 'balance' THEN bb WHEN 'segment' THEN bs ELSE bl END AS blocked,
                     CASE WHEN t.slot = 'balance' THEN t.num ELSE f.balance END AS nb, CASE WHEN t.slot = 'segment' THEN t.word ELSE f.segment END AS ns, CASE WHEN t.slot = 'locked' THEN true ELSE f.locked END AS nl
              FROM {made} f JOIN {made}_todo t ON t.zone = f.zone AND t.i = f.i + 1) x) y)"""


def _next_sql(fold: str = "fold", zones: str = "zones", made: str = "next") -> str:
    return f"""{made} AS (SELECT z.zone, coalesce(b, balance) AS balance, coalesce(s, segment) AS segment, coalesce(l, locked) AS locked FROM {zones} z
  LEFT JOIN (SELECT zone, arg_max(balance, i) AS b, arg_max(segment, i) AS s, arg_max(locked, i) AS l FROM {fold} GROUP BY zone) e USING (zone))"""


STEP = f"{ZONES}, {LOG}, {WINDOW}, {RULES}, {_enabled_sql()}"
FOLD = f"WITH RECURSIVE {STEP}, {_fold_sql()}"


def _lines_sql(zones: str) -> str:
    return f"""SELECT zone, '<' || zone || '> <urn:acc:balance> "' || balance || '"^^<{DECIMAL}> .' AS line FROM {zones}
  UNION ALL SELECT zone, '<' || zone || '> <urn:acc:segment> "' || segment || '" .' FROM {zones}
  UNION ALL SELECT zone, '<' || zone || '> <urn:acc:locked> "' || locked || '"^^<{BOOLEAN}> .' FROM {zones}
  UNION ALL SELECT zone, '<' || zone || '> <{RDF_TYPE}> <urn:acc:Zone> .' FROM {zones}"""


POLICY_LINES = " UNION ALL ".join([f"SELECT '<urn:acc:Policy> <{RDF_TYPE}> <urn:acc:ControlPolicy> .' AS line", *[f"SELECT '<urn:acc:Policy> <urn:acc:{k}> \"{v}\"^^<{DECIMAL}> .'" for k, v in cases.POLICY.items()]])

# --- scans and projections ------------------------------------------------------------


@query(f"WITH {LOG} SELECT eid, {_iso('ts_key')} AS timestamp, event_type AS type, role, zone, CAST(CAST(cents AS BIGINT) AS VARCHAR) AS cents, CAST(CAST(k AS BIGINT) AS VARCHAR) AS k FROM log")
def src_events_scan(spark, d):
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/events-{abs(hash(d))}.jsonl"
    cases.log(spark, d).write.mode("overwrite").json(path)
    return readers.read_events(spark, path).select("eid", "timestamp", "type", "role", *[F.col("payload")[k].alias(k) for k in ("zone", "cents", "k")])


@query(f"WITH {RULES} SELECT rid, CAST(priority AS INTEGER) AS priority, issuing AS issuing_role, 'urn:acc:' || slot AS predicate FROM rules")
def src_rules_dim(spark, d):
    return readers.rules_frame(spark, cases.RULES).drop("value_expr")


@query(f"WITH {LOG} SELECT eid, ts_key FROM log")
def tskey_micros(spark, d):
    return windowing.with_instants(cases.log(spark, d)).select("eid", "ts_key")


EVENT_QUADS = f"""{LOG}, o AS (SELECT *, row_number() OVER (ORDER BY ts_key, eid) - 1 AS ordinal FROM log),
quads AS (SELECT 'urn:window' AS g, 'urn:event:' || eid AS s, 'urn:prop:' || p AS p, kind, lex, dt FROM (
  SELECT eid, 'eid' AS p, 'lit' AS kind, eid AS lex, NULL AS dt FROM o UNION ALL SELECT eid, 'timestamp', 'lit', {_iso('ts_key')}, NULL FROM o
  UNION ALL SELECT eid, 'type', 'lit', event_type, NULL FROM o UNION ALL SELECT eid, 'role', 'lit', role, NULL FROM o
  UNION ALL SELECT eid, 'order', 'lit', CAST(ordinal AS VARCHAR), '{INTEGER}' FROM o UNION ALL SELECT eid, 'zone', 'iri', zone, NULL FROM o
  UNION ALL SELECT eid, 'cents', 'lit', CAST(cents AS VARCHAR), '{DECIMAL}' FROM o UNION ALL SELECT eid, 'k', 'lit', CAST(k AS VARCHAR), '{DECIMAL}' FROM o) t)"""


def _event_quads(spark, d):
    chosen, _ = windowing.select_window(cases.log(spark, d), {"type": "all"})
    return windowing.event_quads(chosen, cases.DOMAIN)


def _quads(spark, d, named=None):
    """State and events as quads; with ``named`` only those of these predicates are written."""
    quads = windowing.state_quads(cases.state(spark, d)).unionByName(_event_quads(spark, d))
    return written(quads if named is None else quads.where(F.col("p").isin(sorted(named))), "all-quads")


@query(f"WITH {EVENT_QUADS} SELECT * FROM quads")
def event_to_triples(spark, d):
    return _event_quads(spark, d).select("g", "s", "p", "o.kind", "o.lex", "o.dt")


@query(f"""WITH {ZONES}, l AS ({_lines_sql('zones')}), p AS ({POLICY_LINES}) SELECT 'urn:state' AS g, line FROM (SELECT line FROM l UNION ALL SELECT line FROM p) t""")
def state_to_quads(spark, d):
    quads = windowing.state_quads(cases.state(spark, d))
    return canon.lines(quads).select(F.lit(windowing.STATE_GRAPH).alias("g"), "line")


# --- conditions -----------------------------------------------------------------------

PREFIX = "PREFIX a: <urn:acc:> SELECT "


def _select(spark, d, text: str):
    found = sparql.parse(PREFIX + text)
    return sparql.to_frame(_quads(spark, d, sparql.predicates(found)), found)


@query(f"WITH {LOG} SELECT eid, zone, CAST(cents AS VARCHAR) AS cents FROM log WHERE event_type = 'purchase'")
def bgp_star_join(spark, d):
    found = _select(spark, d, '?eid ?zone ?cents WHERE { GRAPH <urn:window> { ?e <urn:prop:type> "purchase" ; <urn:prop:eid> ?eid ; <urn:prop:zone> ?zone ; <urn:prop:cents> ?cents . } }')
    return found.select(*[F.col(c)["lex"].alias(c) for c in found.columns])


@query(f"WITH {LOG}, {ZONES} SELECT eid, l.zone, CAST(balance AS VARCHAR) AS balance, segment FROM log l JOIN zones z ON l.zone = z.zone WHERE event_type = 'purchase' AND cents > 2000 AND balance > 100000")
def event_state_join(spark, d):
    found = _select(spark, d, '''?eid ?zone ?balance ?segment WHERE { GRAPH <urn:window> { ?e <urn:prop:type> "purchase" ; <urn:prop:eid> ?eid ; <urn:prop:zone> ?zone ; <urn:prop:cents> ?cents . }
      GRAPH <urn:state> { ?zone a a:Zone ; a:balance ?balance ; a:segment ?segment . } FILTER (?cents > 2000 && ?balance > 100000) }''')
    return found.select(*[F.col(c)["lex"].alias(c) for c in found.columns])


@query(f"WITH {LOG}, {ZONES} SELECT eid, z.zone FROM log, zones z WHERE event_type = 'error' AND cents > 9000 AND z.segment = 'BUILDING'")
def event_state_cross(spark, d):
    """Every event of a kind with every node of a kind: the pattern has no variable in common."""
    found = _select(spark, d, '''?eid ?zone WHERE { GRAPH <urn:window> { ?e <urn:prop:type> "error" ; <urn:prop:eid> ?eid ; <urn:prop:cents> ?cents . }
      GRAPH <urn:state> { ?zone a a:Zone ; a:segment "BUILDING" . } FILTER (?cents > 9000) }''')
    return found.select(*[F.col(c)["lex"].alias(c) for c in found.columns])


@query(f"WITH {LOG}, {ZONES} SELECT eid, l.zone FROM log l JOIN zones z ON l.zone = z.zone AND z.segment = 'BUILDING' WHERE event_type = 'click'")
def existential_semi(spark, d):
    found = _select(spark, d, '?eid ?zone WHERE { GRAPH <urn:window> { ?e <urn:prop:type> "click" ; <urn:prop:eid> ?eid ; <urn:prop:zone> ?zone . } FILTER EXISTS { GRAPH <urn:state> { ?zone a:segment "BUILDING" . } } }')
    return found.select(*[F.col(c)["lex"].alias(c) for c in found.columns])


@query(f"WITH {LOG} SELECT zone FROM (SELECT DISTINCT zone FROM log WHERE event_type = 'view') v WHERE zone NOT IN (SELECT zone FROM log WHERE event_type = 'error' AND cents > 8000)")
def ledger_anti(spark, d):
    found = _select(spark, d, 'DISTINCT ?zone WHERE { GRAPH <urn:window> { ?e <urn:prop:type> "view" ; <urn:prop:zone> ?zone . } MINUS { GRAPH <urn:window> { ?f <urn:prop:type> "error" ; <urn:prop:zone> ?zone ; <urn:prop:cents> ?c . } FILTER (?c > 8000) } }')
    return found.select(F.col("zone")["lex"].alias("zone"))


@query(f"""WITH {LOG}, {ZONES}, f AS (SELECT zone, count(*) AS n FROM log WHERE event_type = 'signup' GROUP BY zone) SELECT z.zone, n FROM zones z LEFT JOIN f ON z.zone = f.zone""")
def state_optional(spark, d):
    found = _select(spark, d, '''?zone ?n WHERE { GRAPH <urn:state> { ?zone a a:Zone . }
      OPTIONAL { { SELECT ?zone (COUNT(*) AS ?n) WHERE { GRAPH <urn:window> { ?e <urn:prop:type> "signup" ; <urn:prop:zone> ?zone . } } GROUP BY ?zone } } }''')
    return found.select(F.col("zone")["lex"].alias("zone"), F.col("n")["lex"].cast("bigint").alias("n"))


@query(f"""WITH {LOG} SELECT event_type AS kind, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, CAST(min(cents) AS BIGINT) AS low, CAST(max(cents) AS BIGINT) AS high FROM log WHERE event_type IN ('click', 'view') GROUP BY 1""")
def union_aggregate(spark, d):
    found = _select(spark, d, '''?kind (COUNT(*) AS ?n) (SUM(?cents) AS ?total) (MIN(?cents) AS ?low) (MAX(?cents) AS ?high) WHERE { GRAPH <urn:window> { ?e <urn:prop:cents> ?cents ; <urn:prop:type> ?kind .
      { ?e <urn:prop:type> "click" . } UNION { ?e <urn:prop:type> "view" . } } } GROUP BY ?kind''')
    return found.select(F.col("kind")["lex"].alias("kind"), *[F.col(c)["lex"].cast("double").cast("bigint").alias(c) for c in ("n", "total", "low", "high")])


# --- windows --------------------------------------------------------------------------


@query(f"WITH {LOG}, {WINDOW} SELECT eid, row_number() OVER (ORDER BY ts_key, eid) - 1 AS ordinal, window_id FROM recent, wid")
def window_sliding_closed(spark, d):
    chosen, meta = windowing.select_window(cases.log(spark, d), cases.SETTINGS["window"])
    return chosen.select("eid", F.col("ordinal").cast("bigint").alias("ordinal"), F.lit(meta["window_id"]).alias("window_id"))


@query(f"WITH {LOG}, h AS (SELECT (max(ts_key) // {DAY} + 1) * {DAY} AS e FROM log) SELECT eid FROM log, h WHERE ts_key >= e - {3 * DAY} AND ts_key < e")
def window_tumbling(spark, d):
    return windowing.select_window(cases.log(spark, d), {"type": "tumbling", "length_minutes": 3 * 1440, "step_minutes": 1440})[0].select("eid")


@query(f"WITH {LOG} SELECT eid, row_number() OVER (ORDER BY ts_key, eid) - 1 AS ordinal FROM log")
def window_unbounded(spark, d):
    return windowing.select_window(cases.log(spark, d), {"type": "all"})[0].select("eid", F.col("ordinal").cast("bigint").alias("ordinal"))


# --- actions --------------------------------------------------------------------------


@query(f"WITH {STEP} SELECT aid, rid, eid, zone, 'urn:acc:' || slot AS predicate, role, role_rank, CAST(priority AS INTEGER) AS priority, ts_key FROM enabled")
def enabled_actions(spark, d):
    return cases.step(spark, d).enabled.select("aid", "rid", F.col("event_id").alias("eid"), "zone", "predicate", "role", F.col("roleRank").alias("role_rank"), "priority", F.col("tsKey").alias("ts_key"))


@query(f"WITH {STEP} SELECT eid, rid, bind_key FROM enabled")
def action_bindkey(spark, d):
    return cases.step(spark, d).enabled.select(F.col("event_id").alias("eid"), "rid", F.col("bindKey").alias("bind_key"))


@query(f"WITH {STEP} SELECT eid, rid, window_id, aid FROM enabled")
def action_aid(spark, d):
    return cases.step(spark, d).enabled.select(F.col("event_id").alias("eid"), "rid", "window_id", "aid")


def _values(spark, d, rid):
    return cases.step(spark, d).enabled.where(F.col("rid") == rid).select(F.col("event_id").alias("eid"), "value.kind", "value.lex", "value.num")


@query(f"WITH {STEP} SELECT eid, 'number' AS kind, CAST(num AS VARCHAR) AS lex, num FROM enabled WHERE rid = 'r2'")
def value_copy(spark, d):
    return _values(spark, d, "r2")


@query(f"WITH {STEP} SELECT eid, 'string' AS kind, word AS lex, CAST(NULL AS DOUBLE) AS num FROM enabled WHERE rid = 'r6'")
def value_literal(spark, d):
    return _values(spark, d, "r6")


@query(f"WITH {STEP} SELECT eid, 'number' AS kind, CAST(num AS VARCHAR) AS lex, num FROM enabled WHERE rid = 'r7'")
def value_numeric_add(spark, d):
    return _values(spark, d, "r7")


@query(f"WITH {STEP} SELECT eid, 'number' AS kind, CAST(num AS VARCHAR) AS lex, num FROM enabled WHERE rid = 'r4'")
def value_add_constant(spark, d):
    return _values(spark, d, "r4")


OPERATORS = {"governance": {"context_name": "duty", "enforce_active_roles": True}}, {"duty": {"active_roles": ["operator", "emergency"]}}


@query(f"WITH {STEP} SELECT aid, role FROM enabled WHERE role IN ('operator', 'emergency')")
def role_filter(spark, d):
    return cases.step(spark, d, *OPERATORS).enabled.select("aid", "role")


@query(f"WITH {STEP} SELECT eid, event_role, role FROM (SELECT eid, role AS event_role, role FROM enabled) t")
def event_role_match(spark, d):
    return cases.step(spark, d).enabled.select(F.col("event_id").alias("eid"), "event_role", "role")


@query(f"WITH {STEP} SELECT aid, CASE role WHEN 'emergency' THEN 5 ELSE 999 END AS rank FROM enabled")
def role_left_default(spark, d):
    chosen, meta = windowing.select_window(cases.log(spark, d), cases.SETTINGS["window"])
    chosen = written(chosen, "window")
    quads = written(windowing.state_quads(cases.state(spark, d)).unionByName(windowing.event_quads(chosen, cases.DOMAIN)), "quads")
    context = readers.governance({"role_precedence": {"emergency": 5}}, None)
    return actions.enable(quads, chosen, cases.RULES, context, meta["window_id"], cases.DOMAIN).select("aid", F.col("roleRank").alias("rank"))


@query(f"WITH {STEP} SELECT aid, row_number() OVER (ORDER BY {ORDER}) - 1 AS schedule_index FROM enabled")
def schedule_total_order(spark, d):
    return cases.step(spark, d).schedule.select("aid", F.col("schedule_index").cast("bigint").alias("schedule_index"))


@query(f"WITH {STEP} SELECT role_rank, CAST(priority AS INTEGER) AS priority, count(*) AS n, count(DISTINCT zone) AS zones FROM enabled GROUP BY 1, 2")
def tie_group_sizes(spark, d):
    return cases.step(spark, d).enabled.groupBy(F.col("roleRank").alias("role_rank"), "priority").agg(F.count("*").alias("n"), F.countDistinct("zone").alias("zones"))


# --- resolution -----------------------------------------------------------------------


@query(FOLD + """, p AS (SELECT aid, policy_reason FROM enabled), b AS (SELECT aid AS b_aid, rid AS b_rid FROM enabled)
  SELECT f.aid, f.rid, f.eid, reason = 'admissible' AS accepted, reason, policy_reason, blocker AS blocked_by_aid, b_rid AS blocked_by_rid FROM fold f JOIN p ON f.aid = p.aid LEFT JOIN b ON blocker = b_aid WHERE i > 0""")
def step_decisions(spark, d):
    return cases.step(spark, d).decisions.select("aid", "rid", F.col("event_id").alias("eid"), "accepted", "reason", "policy_reason", "blocked_by_aid", "blocked_by_rid")


@query(f"WITH {STEP} SELECT aid, policy_reason FROM enabled WHERE slot = 'balance'")
def policy_guard(spark, d):
    return cases.step(spark, d).decisions.where(F.col("target_key").endswith("balance")).select("aid", "policy_reason")


CLASS_SQL = "CASE WHEN reason LIKE 'policy_min%' THEN 'policy_min_violation' WHEN reason LIKE 'policy_role_cap%' THEN 'policy_role_cap_violation' ELSE reason END"


@query(FOLD + f" SELECT {CLASS_SQL} AS reason_class, count(*) AS n FROM fold WHERE i > 0 GROUP BY 1")
def reason_class(spark, d):
    return cases.step(spark, d).decisions.groupBy(trace.reason_class(F.col("reason")).alias("reason_class")).agg(F.count("*").alias("n"))


@query(FOLD + " SELECT count(*) AS enabled_count, count(*) AS scheduled_count, count(*) FILTER (reason = 'admissible') AS accepted_count, count(*) FILTER (reason <> 'admissible') AS rejected_count FROM fold WHERE i > 0")
def trace_summary(spark, d):
    return trace.tables(cases.step(spark, d))["summary"]


@query(FOLD + f", {_next_sql()}, l AS ({_lines_sql('next')}), p AS ({POLICY_LINES}) SELECT line FROM l UNION ALL SELECT line FROM p")
def successor_lines(spark, d):
    return canon.lines(cases.step(spark, d).successor)


@query(FOLD + f", {_next_sql()}, l AS ({_lines_sql('next')}), p AS ({POLICY_LINES}) SELECT count(*) AS triple_count, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT line FROM l UNION ALL SELECT line FROM p) t")
def graph_digest(spark, d):
    return canon.snapshot(cases.step(spark, d).successor).select("triple_count", "digest")


@query(FOLD + f", {_next_sql()}, a AS ({_lines_sql('zones')}), b AS ({_lines_sql('next')}) SELECT line FROM (SELECT line FROM a EXCEPT SELECT line FROM b) t")
def graph_delta_removed(spark, d):
    found = cases.step(spark, d)
    return canon.delta(found.state, found.successor)[0]


@query(FOLD + f", {_next_sql()}, a AS ({_lines_sql('zones')}), b AS ({_lines_sql('next')}) SELECT line FROM (SELECT line FROM b EXCEPT SELECT line FROM a) t")
def graph_delta_inserted(spark, d):
    found = cases.step(spark, d)
    return canon.delta(found.state, found.successor)[1]


@query(f"""WITH {STEP}, o AS (SELECT *, row_number() OVER (PARTITION BY zone, slot ORDER BY role_rank DESC, priority DESC, ts_key DESC, rid DESC, bind_key DESC, aid DESC) AS r FROM enabled)
  SELECT '<' || zone || '> <urn:acc:' || slot || '> "' || shown || '"' || CASE slot WHEN 'balance' THEN '^^<{DECIMAL}>' WHEN 'locked' THEN '^^<{BOOLEAN}>' ELSE '' END || ' .' AS line FROM o WHERE r = 1""")
def last_writer_wins(spark, d):
    found = cases.step(spark, d)
    after = resolution.last_writer_wins(found.state, found.schedule, cases.DOMAIN)
    written_slots = found.schedule.select(F.col("zone").alias("s"), F.col("predicate").alias("p")).distinct()
    return canon.lines(after.join(written_slots, ["s", "p"], "left_semi"))


def _subject_sql(kind: str) -> str:
    return f"""SELECT aid, sha256('<' || zone || '> <{RDF_TYPE}> <urn:acc:Zone> .' || chr(10) || '<' || zone || '> <urn:acc:balance> "' || {kind}balance || '"^^<{DECIMAL}> .' || chr(10)
  || '<' || zone || '> <urn:acc:locked> "' || {kind}locked || '"^^<{BOOLEAN}> .' || chr(10) || '<' || zone || '> <urn:acc:segment> "' || {kind}segment || '" .')"""


@query(FOLD + f""", along AS (SELECT *, lag(balance) OVER w AS p_balance, lag(segment) OVER w AS p_segment, lag(locked) OVER w AS p_locked FROM fold WINDOW w AS (PARTITION BY zone ORDER BY i))
  SELECT a.aid, a.pre AS pre_digest, b.post AS post_digest FROM ({_subject_sql('p_')} AS pre FROM along WHERE i > 0) a JOIN ({_subject_sql('')} AS post FROM along WHERE i > 0) b ON a.aid = b.aid""")
def asof_digests(spark, d):
    found = cases.step(spark, d)
    along = canon.subject_digests_along(found.state, found.decisions)
    return found.decisions.select("aid", "schedule_index").join(along, "schedule_index").select("aid", F.col("pre_graph_digest").alias("pre_digest"), F.col("post_graph_digest").alias("post_digest"))


@query(FOLD + f""", s AS (SELECT aid, row_number() OVER (ORDER BY {ORDER}) - 1 AS place FROM enabled) SELECT CAST(place AS INTEGER) AS schedule_index, reason AS recorded, 'altered' AS regenerated FROM fold JOIN s USING (aid) WHERE i > 0 AND place % 7 = 3""")
def replay_compare(spark, d):
    """A trace written, read again and compared with itself altered at known places."""
    found = cases.step(spark, d)
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/trace-{abs(hash((d, id(found))))}"
    if not StepStore(spark, folder)._exists(f"{folder}/summary"):
        trace.write_tables(found, folder)
    recorded = trace.read_tables(spark, folder)["decisions"]
    again = found.decisions.withColumn("reason", F.when(F.col("schedule_index") % 7 == 3, "altered").otherwise(F.col("reason")))
    return trace.differences(recorded, again, ("aid", "accepted", "reason", "target_key")).select("schedule_index", F.col("recorded.reason").alias("recorded"), F.col("regenerated.reason").alias("regenerated"))


@query("SELECT unnest(['accepted', 'decisions', 'digest', 'enabled', 'schedule']) AS axis, true AS same")
def replay_axes(spark, d):
    """The step's tables against a step made anew from its events and input graph."""
    found = cases.step(spark, d)
    recorded = {**trace.tables(found)}
    axes = trace.replay_full(spark, recorded, cases.RULES, cases.shapes(), cases.SETTINGS, None, found.window["anchor_timestamp"], cases.DOMAIN)
    return spark.createDataFrame([(k, axes[k]) for k in ("accepted", "decisions", "digest", "enabled", "schedule")], "axis string, same boolean")


# --- constraints ----------------------------------------------------------------------

#: A state that is not clamped, so that constraints find something.
RAW = "raw AS (SELECT 'urn:zone:' || c_custkey AS node, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS DOUBLE) AS balance, c_mktsegment AS segment, c_nationkey FROM customer)"
CHECKS = """
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix a: <urn:acc:> .
a:Range a sh:NodeShape ; sh:targetClass a:Zone ; sh:property [ sh:path a:balance ; sh:minInclusive 0 ; sh:maxExclusive 900000 ] .
a:Enum a sh:NodeShape ; sh:targetClass a:Zone ; sh:property [ sh:path a:segment ; sh:in ( "BUILDING" "MACHINERY" ) ] .
a:Datatype a sh:NodeShape ; sh:targetClass a:Zone ; sh:property [ sh:path a:segment ; sh:datatype xsd:integer ] .
a:Length a sh:NodeShape ; sh:targetClass a:Zone ; sh:property [ sh:path a:segment ; sh:minLength 9 ; sh:maxLength 9 ; sh:pattern "^[A-M]" ] .
a:Node a sh:NodeShape ; sh:targetNode <urn:zone:7> ; sh:property [ sh:path a:balance ; sh:maxInclusive -100000 ] .
a:Count a sh:NodeShape ; sh:targetClass a:Nation ; sh:property [ sh:path a:holds ; sh:minCount 2 ; sh:maxCount 6 ] .
a:Rule a sh:NodeShape ; sh:targetClass a:Zone ; sh:sparql [ sh:message "rich building" ; sh:select "PREFIX a: <urn:acc:> SELECT $this WHERE { $this a:segment \\"BUILDING\\" ; a:balance ?b . FILTER (?b > 500000) }" ] .
a:Budget a sh:NodeShape ; sh:targetClass a:Nation ; sh:sparql [ sh:message "over budget" ; sh:select "PREFIX a: <urn:acc:> SELECT $this WHERE { { SELECT ?this (SUM(?b) AS ?all) WHERE { ?this a:holds ?z . ?z a:balance ?b . } GROUP BY ?this } FILTER (?all > 2500000) }" ] .
a:Every a sh:NodeShape ; sh:targetClass a:Nation ; sh:sparql [ sh:message "no rich customer" ; sh:select "PREFIX a: <urn:acc:> SELECT $this WHERE { $this a a:Nation . FILTER NOT EXISTS { $this a:holds ?z . ?z a:balance ?b . FILTER (?b > 990000) } }" ] .
"""


def _raw_state(spark, d):
    from edictum.sources.terms import term_column

    rows = accounts.table(spark, d, "customer").select(F.concat(F.lit(cases.NODE), F.col("c_custkey").cast("string")).alias("s"), accounts.cents(F.col("c_acctbal")).cast("double").cast("string").alias("b"), "c_mktsegment", F.concat(F.lit("urn:nation:"), F.col("c_nationkey").cast("string")).alias("n"))
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in ((RDF_TYPE, term_column("iri", F.lit("urn:acc:Zone"))), ("urn:acc:balance", term_column("lit", F.col("b"), DECIMAL)), ("urn:acc:segment", term_column("lit", F.col("c_mktsegment"))))])
    zones = rows.select("s", F.explode(made).alias("t")).select("s", "t.p", "t.o")
    holds = rows.select(F.col("n").alias("s"), F.lit("urn:acc:holds").alias("p"), term_column("iri", F.col("s")).alias("o"))
    nations = accounts.table(spark, d, "nation").select(F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string")).alias("s"), F.lit(RDF_TYPE).alias("p"), term_column("iri", F.lit("urn:acc:Nation")).alias("o"))
    return written(zones.unionByName(holds).unionByName(nations), "raw-state")


def _checked(spark, d, shape: str):
    chosen = [c for c in shacl.parse_shapes(CHECKS) if c.shape == "urn:acc:" + shape]
    return shacl.violations(_raw_state(spark, d), chosen).select("node", "message")


@query(f"WITH {RAW} SELECT node, CASE WHEN balance < 0 THEN 'urn:acc:balance: minInclusive' ELSE 'urn:acc:balance: maxExclusive' END AS message FROM raw WHERE balance < 0 OR balance >= 900000")
def shape_range(spark, d):
    return _checked(spark, d, "Range")


@query(f"WITH {RAW} SELECT node, 'urn:acc:segment: in' AS message FROM raw WHERE segment NOT IN ('BUILDING', 'MACHINERY')")
def shape_enum(spark, d):
    return _checked(spark, d, "Enum")


@query(f"WITH {RAW} SELECT node, 'urn:acc:segment: datatype' AS message FROM raw")
def shape_datatype(spark, d):
    return _checked(spark, d, "Datatype")


@query(f"""WITH {RAW} SELECT node, 'urn:acc:segment: pattern' AS message FROM raw WHERE NOT regexp_matches(segment, '^[A-M]')
  UNION ALL SELECT node, 'urn:acc:segment: minLength' FROM raw WHERE length(segment) < 9 UNION ALL SELECT node, 'urn:acc:segment: maxLength' FROM raw WHERE length(segment) > 9""")
def shape_lengths(spark, d):
    return _checked(spark, d, "Length")


@query(f"WITH {RAW} SELECT node, 'urn:acc:balance: maxInclusive' AS message FROM raw WHERE node = 'urn:zone:7' AND balance > -100000")
def shape_target_node(spark, d):
    return _checked(spark, d, "Node")


@query(f"""WITH {RAW}, h AS (SELECT n_nationkey, count(node) AS n FROM nation LEFT JOIN raw ON c_nationkey = n_nationkey GROUP BY 1)
  SELECT 'urn:nation:' || n_nationkey AS node, CASE WHEN n < 2 THEN 'urn:acc:holds: fewer than minCount' ELSE 'urn:acc:holds: more than maxCount' END AS message FROM h WHERE n < 2 OR n > 6""")
def shape_cardinality(spark, d):
    return _checked(spark, d, "Count")


@query(f"WITH {RAW} SELECT node, 'rich building' AS message FROM raw WHERE segment = 'BUILDING' AND balance > 500000")
def shape_implication(spark, d):
    return _checked(spark, d, "Rule")


@query(f"WITH {RAW} SELECT 'urn:nation:' || c_nationkey AS node, 'over budget' AS message FROM raw GROUP BY c_nationkey HAVING sum(balance) > 2500000")
def shape_budget_sum(spark, d):
    return _checked(spark, d, "Budget")


@query(f"WITH {RAW} SELECT 'urn:nation:' || n_nationkey AS node, 'no rich customer' AS message FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM raw WHERE balance > 990000)")
def shape_universal(spark, d):
    return _checked(spark, d, "Every")


@query(f"""WITH {RAW}, v AS (SELECT 'urn:acc:Enum ' || node || ' urn:acc:segment: in' AS line FROM raw WHERE segment NOT IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT 'urn:acc:Rule ' || node || ' rich building' FROM raw WHERE segment = 'BUILDING' AND balance > 500000
  UNION ALL SELECT 'urn:acc:Range ' || node || CASE WHEN balance < 0 THEN ' urn:acc:balance: minInclusive' ELSE ' urn:acc:balance: maxExclusive' END FROM raw WHERE balance < 0 OR balance >= 900000)
  SELECT count(*) = 0 AS conforms, string_agg(line, chr(10) ORDER BY line) AS report FROM v""")
def validation_report(spark, d):
    chosen = [c for c in shacl.parse_shapes(CHECKS) if c.shape.rpartition(":")[2] in ("Enum", "Rule", "Range")]
    return shacl.report_row(shacl.fault_lines(_raw_state(spark, d), chosen))


# --- steps ----------------------------------------------------------------------------

ANCHORS = ("2024-01-29T00:00:00+00:00", "2024-01-30T00:00:00+00:00")


def _two_steps_sql(consume: bool) -> str:
    """Two anchored windows of one day; the second starts from the first one's state."""
    parts = [ZONES, LOG, RULES]
    for n, anchor in enumerate(ANCHORS, 1):
        at = f"epoch_us(TIMESTAMP '{anchor[:19].replace('T', ' ')}')"
        used = "AND eid NOT IN (SELECT eid FROM fold1 WHERE reason = 'admissible')" if consume and n == 2 else ""
        parts.append(f"recent{n} AS (SELECT * FROM log WHERE ts_key BETWEEN {at} - {3 * DAY // 2} AND {at} {used})")
        parts.append(f"wid{n} AS (SELECT 'sliding:' || {_iso(f'({at} - {3 * DAY // 2})')} || '::' || {_iso(at)} AS window_id)")
        zones = "zones" if n == 1 else "next1"
        parts += [_enabled_sql(f"recent{n}", zones, f"wid{n}", f"enabled{n}"), _fold_sql(f"enabled{n}", zones, f"fold{n}"), _next_sql(f"fold{n}", zones, f"next{n}")]
    return "WITH RECURSIVE " + ", ".join(parts) + " SELECT CAST(step AS INTEGER) AS step, aid, reason FROM (SELECT 0 AS step, * FROM fold1 WHERE i > 0 UNION ALL SELECT 1, * FROM fold2 WHERE i > 0) t"


def _two_steps(spark, d, mode):
    store = StepStore(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{mode}-{abs(hash(d))}-{id(object())}")
    settings = {**cases.SETTINGS, "window": {"type": "sliding", "length_minutes": 2160}}
    steps.run_anchors(spark, cases.state(spark, d), cases.log(spark, d), list(ANCHORS), cases.RULES, cases.shapes(), settings, None, store, mode, cases.DOMAIN)
    parts = [store.decisions(f"anchor-{i:05d}").select(F.lit(i).alias("step"), "aid", "reason") for i in range(2)]
    return parts[0].union(parts[1])


@query(_two_steps_sql(False))
def multi_step_redelivery(spark, d):
    return _two_steps(spark, d, "redelivery")


@query(_two_steps_sql(True))
def multi_step_consume_once(spark, d):
    return _two_steps(spark, d, "consume_once")


@query(f"""WITH {LOG}, a AS (SELECT unnest([0, 1]) AS n, unnest([epoch_us(TIMESTAMP '2024-01-29 00:00:00'), epoch_us(TIMESTAMP '2024-01-30 00:00:00')]) AS anchor)
  SELECT eid FROM log WHERE NOT EXISTS (SELECT 1 FROM a WHERE ts_key BETWEEN anchor - {3 * DAY // 2} AND anchor AND CAST(k AS INTEGER) % 3 <= n)""")
def late_events(spark, d):
    log = cases.log(spark, d).withColumn("arrival_step", F.col("payload")["k"].cast("int") % 3)
    return steps.late(log, list(ANCHORS), 2160).select("eid")


@query()
def streaming_step(spark, d):
    """The log as a stream: one micro-batch, one committed step, the state's digest."""
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{abs(hash(d))}-{id(object())}"
    cases.log(spark, d).write.json(f"{root}/log")
    store = StepStore(spark, f"{root}/store")
    steps.stream_steps(readers.stream_events(spark, f"{root}/log"), cases.state(spark, d), cases.RULES, cases.shapes(), cases.SETTINGS, None, store, f"{root}/checkpoint", cases.DOMAIN).awaitTermination()
    return spark.createDataFrame([(store.current(), store.pointer()["digest"], canon.digest(cases.step(spark, d).successor))], "step string, digest string, batch_digest string")


@query()
def commit_recover(spark, d):
    """A step committed, another one crashed before its pointer, and what recovery finds."""
    store = StepStore(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/commit-{abs(hash(d))}-{id(object())}")
    found = cases.step(spark, d)
    store.commit_state(found.successor, found.decisions, "first")
    try:
        store.commit_state(found.state, found.decisions, "second", crash_at="before_pointer")
    except Crash:
        pass
    done = store.recover()
    return spark.createDataFrame([(done["committed"], done["discarded"], done["verification"]["consistent"])], "committed string, discarded array<string>, consistent boolean")
