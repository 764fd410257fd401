"""The rule engine itself over the driver's tables.

Customers are typed nodes of a state graph, the events table is the log, and rules and shapes
are SPARQL and Turtle texts that go through the engine's own parsers.  A step's tables are
written by ``run_step``; queries of one session over one folder share them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.operators import shacl, windowing
from edictum.plans import accounts
from edictum.plans.engine import Step, run_step
from edictum.sources.domain import Domain
from edictum.sources.readers import triples_frame
from edictum.sources.terms import BOOLEAN, DECIMAL, RDF_TYPE, Term, iri, term_column

BASE, NODE = "urn:acc:", "urn:zone:"
DAYS = 5
RANKS = {"emergency": 0, "operator": 1, "occupant": 2}
POLICY = {"leastBalance": "1000", "occupantMostBalance": "400000", "operatorMostBalance": "800000"}

DOMAIN = Domain(
    base=BASE,
    numeric_keys=("cents", "k"),
    iri_keys=("zone",),
    decimal_predicates=(BASE + "balance",),
    boolean_predicates=(BASE + "locked",),
    guarded=BASE + "balance",
    minimum=BASE + "leastBalance",
    maximum="MostBalance",
    minimum_reason="policy_min_violation",
    capped_roles=("occupant", "operator"),
)

SETTINGS = {"window": {"type": "sliding", "length_minutes": DAYS * 1440}, "role_precedence": RANKS}


def _rule(rid: str, kind: str, priority: int, role: str, slot: str, expr: dict, payload: tuple = (), reads: tuple = (), state: str = "", test: str = "") -> dict:
    shown = " ".join(f"?{v}" for v in ("e", "eid", "zone", *payload, *reads))
    window = "".join(f" ; <urn:prop:{k}> ?{k}" for k in ("eid", "zone", *payload))
    slots = "".join(f" ; a:{r} ?{r}" for r in reads) + state
    text = f'PREFIX a: <{BASE}> SELECT {shown} WHERE {{ GRAPH <urn:window> {{ ?e <urn:prop:type> "{kind}"{window} . }} GRAPH <urn:state> {{ ?zone a a:Zone{slots} . }} {test} }}'
    return {"rid": rid, "priority": priority, "issuing_role": role, "condition_select": text, "insert_template": {"predicate": BASE + slot, "value_expr": expr}}


RULES = [
    _rule("r1", "click", 2, "occupant", "balance", {"kind": "numeric_add", "left": "balance", "right": "cents"}, ("cents",), ("balance",)),
    _rule("r2", "purchase", 1, "operator", "balance", {"kind": "copy", "var": "cents"}, ("cents",)),
    _rule("r3", "signup", 1, "operator", "segment", {"kind": "literal", "value": "HOUSEHOLD"}),
    _rule("r4", "view", 2, "occupant", "balance", {"kind": "numeric_add_constant", "var": "balance", "constant": 100}, (), ("balance",), state=" ; a:locked false"),
    _rule("r5", "error", 1, "emergency", "locked", {"kind": "literal", "value": True}, ("cents",), test="FILTER (?cents > 3000)"),
    _rule("r6", "error", 0, "emergency", "segment", {"kind": "literal", "value": "LOCKED"}, ("cents",), test="FILTER (?cents > 6000)"),
    _rule("r7", "purchase", 1, "operator", "balance", {"kind": "numeric_add", "left": "cents", "right": "k"}, ("cents", "k"), test="FILTER (?k > 50)"),
    _rule("r8", "purchase", 1, "operator", "segment", {"kind": "literal", "value": "OFF"}, ("k",), test="FILTER (?k <= 50)"),
]

SHAPES = f"""
@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix a: <{BASE}> .
a:BalanceShape a sh:NodeShape ; sh:targetClass a:Zone ;
  sh:property [ sh:path a:balance ; sh:minCount 1 ; sh:maxCount 1 ; sh:minInclusive 0 ; sh:maxInclusive 1000000 ] .
a:SegmentShape a sh:NodeShape ; sh:targetClass a:Zone ;
  sh:property [ sh:path a:segment ; sh:minCount 1 ; sh:in ( "AUTOMOBILE" "BUILDING" "FURNITURE" "HOUSEHOLD" "MACHINERY" "LOCKED" "OFF" ) ; sh:maxLength 10 ; sh:pattern "^[A-Z]+$" ] .
a:LockedShape a sh:NodeShape ; sh:targetClass a:Zone ;
  sh:property [ sh:path a:locked ; sh:datatype xsd:boolean ] .
a:LockShape a sh:NodeShape ; sh:targetClass a:Zone ;
  sh:sparql [ sh:message "locked outside LOCKED" ; sh:select "PREFIX a: <{BASE}> SELECT $this WHERE {{ $this a:locked true ; a:segment ?s . FILTER (?s != \\"LOCKED\\") }}" ] .
a:OffShape a sh:NodeShape ; sh:targetClass a:Zone ;
  sh:sparql [ sh:message "too much for OFF" ; sh:select "PREFIX a: <{BASE}> SELECT $this WHERE {{ $this a:segment \\"OFF\\" ; a:balance ?b . FILTER (?b > 500000) }}" ] .
"""


def shapes() -> list[shacl.Constraint]:
    return shacl.parse_shapes(SHAPES)


def state(spark: SparkSession, d: str) -> DataFrame:
    """Four triples of each customer, and the policy node's."""
    slots = (
        (RDF_TYPE, term_column("iri", F.lit(BASE + "Zone"))),
        (BASE + "balance", term_column("lit", F.col("balance").cast("double").cast("string"), DECIMAL)),
        (BASE + "segment", term_column("lit", F.col("segment"))),
        (BASE + "locked", term_column("lit", F.col("locked").cast("string"), BOOLEAN)),
    )
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in slots])
    zones = accounts.zones(spark, d).select(F.concat(F.lit(NODE), F.col("zone").cast("string")).alias("s"), F.explode(made).alias("t")).select("s", "t.p", "t.o")
    policy = [(BASE + "Policy", RDF_TYPE, iri(BASE + "ControlPolicy")), *[(BASE + "Policy", BASE + k, Term("lit", v, DECIMAL)) for k, v in POLICY.items()]]
    return zones.unionByName(triples_frame(spark, policy))


def log(spark: SparkSession, d: str) -> DataFrame:
    """The events table in the form of an event log."""
    rows = accounts.log(spark, d)
    payload = F.create_map(
        F.lit("zone"), F.concat(F.lit(NODE), F.col("zone").cast("string")), F.lit("cents"), F.col("cents").cast("string"), F.lit("k"), F.col("k").cast("string")
    )
    return rows.select(F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("eid"), windowing.iso_column(F.col("ts")).alias("timestamp"), F.col("event_type").alias("type"), "role", payload.alias("payload"))


def fresh_step(spark: SparkSession, d: str, settings: dict | None = None, contexts: dict | None = None) -> Step:
    return run_step(spark, state(spark, d), log(spark, d), RULES, shapes(), {**SETTINGS, **(settings or {})}, contexts, domain=DOMAIN)


_held: dict[tuple, Step] = {}


def _still_there(spark: SparkSession, found: Step) -> bool:
    """Whether the step's tables are in the shared folder yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = [path(x) for frame in (found.schedule, found.decisions) for x in frame.inputFiles()[:1]]
    return all(f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(f) for f in files)


def step(spark: SparkSession, d: str, settings: dict | None = None, contexts: dict | None = None) -> Step:
    """The step of a session over a folder, made once; its tables are in the shared folder."""
    key = (spark.sparkContext.applicationId, d, json.dumps(settings, sort_keys=True), json.dumps(contexts, sort_keys=True))
    if key not in _held or not _still_there(spark, _held[key]):
        _held[key] = fresh_step(spark, d, settings, contexts)
    return _held[key]
