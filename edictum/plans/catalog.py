"""Named queries of the native fold and its neighbours over the driver's tables, and their SQL;
``step_queries`` has those of whole steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edictum.operators import actions as A
from edictum.operators import slots as S
from edictum.operators import windowing as W
from edictum.plans import accounts as M
from edictum.plans import step_queries  # noqa: F401 (registers its queries)
from edictum.plans.accounts import table
from edictum.plans.registry import ORACLES, QUERIES, query  # noqa: F401

DAY = 86_400_000_000
ZONES = """zones AS (SELECT c_custkey AS zone, least(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0), 999999) AS balance,
  c_mktsegment AS segment, false AS locked FROM customer)"""
LOG = """log AS (SELECT event_id, user_id AS zone, event_type, epoch_us(ts) AS ts_key, CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type = 'error' THEN 'emergency' WHEN event_type IN ('purchase', 'signup') THEN 'operator' ELSE 'occupant' END AS role
  FROM events)"""
RECENT = "recent AS (SELECT * FROM log)"
RULES = """rules(rid, kind, priority, slot) AS (VALUES ('r1','click',2,'balance'),('r2','purchase',1,'balance'),('r3','signup',1,'segment'),
  ('r4','view',2,'balance'),('r5','error',1,'locked'),('r6','error',0,'segment'),('r7','purchase',1,'balance'),('r8','purchase',1,'segment'))"""
ENABLED = """en0 AS (SELECT l.zone, event_id, ts_key, role,
    CASE role WHEN 'emergency' THEN 0 WHEN 'operator' THEN 1 ELSE 2 END AS role_rank, rid, priority, slot,
    CASE rid WHEN 'r1' THEN balance + cents WHEN 'r2' THEN cents * 10 WHEN 'r4' THEN balance + 100 WHEN 'r7' THEN k * 10000 END AS to_balance,
    CASE rid WHEN 'r3' THEN 'HOUSEHOLD' WHEN 'r6' THEN 'LOCKED' WHEN 'r8' THEN 'OFF' END AS to_segment,
    CASE rid WHEN 'r5' THEN true END AS to_locked,
    '{"cents":' || cents || ',"eid":"' || event_id || '","zone":"' || l.zone || '"}' AS bind_key
  FROM recent l JOIN zones z ON l.zone = z.zone JOIN rules r ON r.kind = l.event_type
  WHERE CASE rid WHEN 'r4' THEN NOT locked WHEN 'r5' THEN cents > 3000 WHEN 'r6' THEN cents > 6000 WHEN 'r7' THEN k > 50 WHEN 'r8' THEN k <= 50 ELSE true END),
en1 AS (SELECT *, sha256('{"bindings":' || bind_key || ',"rid":"' || rid || '","slot":"' || slot || '"}') AS aid,
    CASE role WHEN 'emergency' THEN 900000 WHEN 'operator' THEN 800000 ELSE 400000 END AS cap FROM en0),
enabled AS (SELECT *, CASE WHEN slot <> 'balance' THEN NULL
    WHEN to_balance < 1000 THEN 'policy_min_violation:' || to_balance || ' < 1000'
    WHEN to_balance > cap THEN 'policy_role_cap_violation:' || role || ':' || to_balance || ' > ' || cap END AS refused FROM en1)"""
BASE = f"{ZONES}, {LOG}, {RECENT}, {RULES}, {ENABLED}"
ADMISSIBLE = """(nb BETWEEN 0 AND 1000000 AND ns IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY','LOCKED','OFF')
  AND (NOT nl OR ns = 'LOCKED') AND (ns <> 'OFF' OR nb <= 500000))"""


def _fold_sql(conflict: bool, guarded: bool = True) -> str:
    """The fold as a recursive CTE, one step per place in an entity's schedule."""
    refused = "refused" if guarded else "CAST(NULL AS VARCHAR)"
    shadow = "CASE slot WHEN 'balance' THEN bb WHEN 'segment' THEN bs ELSE bl END" if conflict else "CAST(NULL AS VARCHAR)"
    return f"""todo AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY role_rank, priority, ts_key, rid, aid) AS i FROM enabled),
fold AS (
  SELECT z.zone, CAST(0 AS BIGINT) AS i, balance, segment, locked, CAST(NULL AS VARCHAR) AS bb, CAST(NULL AS VARCHAR) AS bs, CAST(NULL AS VARCHAR) AS bl,
         CAST(NULL AS VARCHAR) AS aid, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS blocked_by
  FROM zones z WHERE zone IN (SELECT zone FROM todo)
  UNION ALL
  SELECT zone, i, CASE WHEN reason = 'admissible' THEN nb ELSE balance END, CASE WHEN reason = 'admissible' THEN ns ELSE segment END,
         CASE WHEN reason = 'admissible' THEN nl ELSE locked END,
         CASE WHEN reason = 'admissible' AND slot = 'balance' AND bb IS NULL THEN aid ELSE bb END,
         CASE WHEN reason = 'admissible' AND slot = 'segment' AND bs IS NULL THEN aid ELSE bs END,
         CASE WHEN reason = 'admissible' AND slot = 'locked' AND bl IS NULL THEN aid ELSE bl END,
         aid, reason, CASE WHEN reason LIKE 'shadowed%' THEN blocker END
  FROM (SELECT *, CASE WHEN ref IS NOT NULL THEN ref WHEN blocker IS NOT NULL THEN 'shadowed_by_prior_accepted_action'
                       WHEN {ADMISSIBLE} THEN 'admissible' ELSE 'inadmissible' END AS reason
        FROM (SELECT f.zone, t.i, f.balance, f.segment, f.locked, bb, bs, bl, t.aid, t.slot, {refused} AS ref, {shadow} AS blocker,
                     CASE WHEN slot = 'balance' THEN to_balance ELSE f.balance END AS nb,
                     CASE WHEN slot = 'segment' THEN to_segment ELSE f.segment END AS ns,
                     CASE WHEN slot = 'locked' THEN to_locked ELSE f.locked END AS nl
              FROM fold f JOIN todo t ON t.zone = f.zone AND t.i = f.i + 1) x) y)"""


FOLD = f"WITH RECURSIVE {BASE}, {_fold_sql(True)}"


def _enabled(spark: SparkSession, d: str) -> DataFrame:
    return M.enabled(M.log(spark, d), M.zones(spark, d))


def _folded(spark: SparkSession, d: str, conflict: bool = True, guarded: bool = True) -> DataFrame:
    acts = _enabled(spark, d)
    if not guarded:
        acts = acts.withColumn("refused", F.lit(None).cast("string"))
    return S.fold_slots(acts, M.zones(spark, d), "zone", M.SLOTS, M.ORDER, M.admissible, conflict)


# --- windows --------------------------------------------------------------------------


HOP_SQL = f"""h AS (SELECT (max(ts_key) // {DAY} + 1) * {DAY} AS e FROM log)"""


@query(f"WITH {LOG}, {HOP_SQL} SELECT event_id FROM log, h WHERE ts_key >= e - {3 * DAY} AND ts_key < e")
def window_hopping_anchor(spark, d):
    rows = M.log(spark, d)
    bounds = rows.agg(F.max("ts_key").alias("a")).select(*[c.alias(n) for c, n in zip(W.tumbling_bounds(F.col("a"), 3 * 1440, 1440), ("b", "e"), strict=True)])
    return rows.join(F.broadcast(bounds), (F.col("ts_key") >= F.col("b")) & (F.col("ts_key") < F.col("e"))).select("event_id")


ANCHORS = [f"2024-01-{x:02d} 00:00:00" for x in range(6, 31, 3)]
ANCHOR_SQL = "anchors AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{a}'" for a in ANCHORS) + "]) AS anchor)"


def _anchors(spark):
    return spark.createDataFrame([(a,) for a in ANCHORS], "a string").select(F.to_timestamp("a").alias("anchor"))


def _multi(spark, d):
    return W.window_join(M.log(spark, d), _anchors(spark), 5 * 1440).withColumn("anchor_key", F.unix_micros("anchor"))


MULTI_SQL = f"""{LOG}, {ANCHOR_SQL}, multi AS (SELECT l.*, anchor, epoch_us(anchor) AS anchor_key FROM log l JOIN anchors a
  ON l.ts_key BETWEEN epoch_us(anchor) - {5 * DAY} AND epoch_us(anchor))"""


@query(f"WITH {MULTI_SQL} SELECT anchor_key, count(*) AS n, sum(cents) AS total FROM multi GROUP BY anchor_key")
def window_multi_anchor(spark, d):
    return _multi(spark, d).groupBy("anchor_key").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))


@query(f"WITH {MULTI_SQL} SELECT anchor_key, event_id, row_number() OVER (PARTITION BY anchor_key ORDER BY ts_key, event_id) - 1 AS ordinal FROM multi")
def window_ordinal(spark, d):
    return _multi(spark, d).select("anchor_key", "event_id", (F.row_number().over(Window.partitionBy("anchor_key").orderBy("ts_key", "event_id")) - 1).cast("bigint").alias("ordinal"))


@query(f"""WITH {ANCHOR_SQL} SELECT 'sliding:' || strftime(anchor - INTERVAL 5 DAY, '%Y-%m-%dT%H:%M:%S+00:00') || '::' || strftime(anchor, '%Y-%m-%dT%H:%M:%S+00:00') AS window_id FROM anchors""")
def window_id_meta(spark, d):
    start = F.expr("anchor - INTERVAL 5 DAYS")
    return _anchors(spark).select(F.concat(F.lit("sliding:"), W.iso_column(start), F.lit("::"), W.iso_column(F.col("anchor"))).alias("window_id"))


# --- values, identity, filters --------------------------------------------------------


@query(f"""WITH {BASE}, o AS (SELECT *, row_number() OVER (PARTITION BY zone, slot ORDER BY role_rank, priority, ts_key, rid, aid) AS r FROM enabled)
  SELECT zone, slot, aid FROM o WHERE r = 1""")
def first_writer_simple(spark, d):
    key = F.struct(*M.ORDER)
    return _enabled(spark, d).groupBy("zone", "slot").agg(F.min_by("aid", key).alias("aid"))


# --- resolution -----------------------------------------------------------------------


@query(FOLD + " SELECT zone, i - 1 AS place, aid AS id, reason = 'admissible' AS accepted, reason, blocked_by FROM fold WHERE i > 0")
def resolve_zone_fold(spark, d):
    return S.decisions(_folded(spark, d), "zone").withColumn("place", F.col("place").cast("bigint"))


CLASS_SQL = "CASE WHEN reason LIKE 'policy_min%' THEN 'policy_min' WHEN reason LIKE 'policy_role_cap%' THEN 'policy_cap' ELSE reason END"


def _reason_class(reason):
    return F.when(reason.startswith("policy_min"), "policy_min").when(reason.startswith("policy_role_cap"), "policy_cap").otherwise(reason)


@query(FOLD + f" SELECT {CLASS_SQL} AS reason_class, count(*) AS n FROM fold WHERE i > 0 GROUP BY 1")
def resolve_reason_hist(spark, d):
    return S.decisions(_folded(spark, d), "zone").groupBy(_reason_class(F.col("reason")).alias("reason_class")).agg(F.count("*").alias("n"))


SUCCESSOR_SQL = """last AS (SELECT zone, arg_max(balance, i) AS b, arg_max(segment, i) AS s, arg_max(locked, i) AS l FROM fold GROUP BY zone),
next AS (SELECT z.zone, coalesce(b, balance) AS balance, coalesce(s, segment) AS segment, coalesce(l, locked) AS locked FROM zones z LEFT JOIN last USING (zone))"""


def _successor(spark, d):
    ends = _folded(spark, d).select("zone", *[F.col(s).alias(f"n_{s}") for s in M.SLOTS])
    return M.zones(spark, d).join(ends, "zone", "left").select("zone", *[F.coalesce(f"n_{s}", s).alias(s) for s in M.SLOTS])


@query(FOLD + f", {SUCCESSOR_SQL} SELECT * FROM next")
def resolve_successor_state(spark, d):
    return _successor(spark, d)


@query(f"WITH RECURSIVE {BASE}, {_fold_sql(False, False)} SELECT zone, aid AS id, reason FROM fold WHERE i > 0")
def gated_no_shadow(spark, d):
    return S.decisions(_folded(spark, d, conflict=False, guarded=False), "zone").select("zone", "id", "reason")


@query("""WITH RECURSIVE q AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS a,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
  f AS (SELECT c, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS a, false AS ok FROM (SELECT DISTINCT c FROM q)
    UNION ALL SELECT f.c, q.i, CASE WHEN f.total + q.a <= 100000000 THEN f.total + q.a ELSE f.total END, q.k, q.a, f.total + q.a <= 100000000
    FROM f JOIN q ON q.c = f.c AND q.i = f.i + 1)
  SELECT c AS customer, CAST(k AS VARCHAR) AS id, a AS amount, ok AS accepted FROM f WHERE i > 0""")
def resolve_budget_greedy(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate", "o_orderkey", F.col("o_orderkey").alias("id"), M.cents(F.col("o_totalprice")).alias("amount"), F.lit(100_000_000).cast("bigint").alias("budget"))
    return S.fold_budget(rows, "customer", ["o_orderdate", "o_orderkey"], "amount", "budget")


# --- canonical forms, replay ----------------------------------------------------------

LINES_SQL = """SELECT zone, '<urn:zone:' || zone || '> <balance> "' || balance || '" .' AS line FROM {0} UNION ALL SELECT zone, '<urn:zone:' || zone || '> <segment> "' || segment || '" .' FROM {0}
  UNION ALL SELECT zone, '<urn:zone:' || zone || '> <locked> "' || locked || '" .' FROM {0}"""


def _lines(state):
    slot = [F.concat(F.lit("<urn:zone:"), F.col("zone").cast("string"), F.lit(f'> <{s}> "'), F.col(s).cast("string"), F.lit('" .')) for s in M.SLOTS]
    return state.select("zone", F.explode(F.array(*slot)).alias("line"))


@query(f"WITH {ZONES}, l AS ({LINES_SQL.format('zones')}) SELECT zone, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY zone")
def component_digests(spark, d):
    return _lines(M.zones(spark, d)).groupBy("zone").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))


# --- steps ----------------------------------------------------------------------------


@query(f"WITH {ZONES} SELECT segment, count(DISTINCT sha256(balance || '|' || segment)) AS unique_states FROM zones GROUP BY 1")
def unique_state_count(spark, d):
    return M.zones(spark, d).groupBy("segment").agg(F.countDistinct(F.sha2(F.concat_ws("|", F.col("balance").cast("string"), "segment"), 256)).alias("unique_states"))


@query(f"WITH {LOG} SELECT event_type, CAST(round(avg(cents)) AS BIGINT) AS mean, CAST(round(stddev_samp(cents)) AS BIGINT) AS sd, max(cents) AS peak, CAST(round(100000 * avg(CASE WHEN k > 50 THEN 1 ELSE 0 END)) AS BIGINT) AS rate FROM log GROUP BY 1")
def runtime_stats(spark, d):
    rate = F.avg(F.when(F.col("k") > 50, 1).otherwise(0))
    return M.log(spark, d).groupBy("event_type").agg(F.round(F.avg("cents")).cast("bigint").alias("mean"), F.round(F.stddev_samp("cents")).cast("bigint").alias("sd"), F.max("cents").alias("peak"), F.round(100000 * rate).cast("bigint").alias("rate"))


@query()
def random_order(spark, d):
    return A.random_order(_enabled(spark, d), 17, ("zone",)).select("zone", "aid", "schedule_index")


@query()
def tie_random_order(spark, d):
    return A.tie_random_order(_enabled(spark, d), 17, ("role_rank", "priority", "ts_key"), ("zone",)).select("zone", "aid", "schedule_index")
