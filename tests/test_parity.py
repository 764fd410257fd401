"""Frames against the in-memory evaluators, the fold against a second resolver, identities."""

import csv
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from edictum.functions import values
from edictum.operators import actions, canon, resolution, shacl, sparql, windowing
from edictum.plans import crosscheck, presets, trace
from edictum.plans.engine import run_step
from edictum.sources import readers, synthetic
from edictum.sources.domain import BUILDING, EV, HVAC
from edictum.sources.terms import BOOLEAN, DECIMAL, INTEGER, RDF_TYPE, Term, iri
from tests.test_engine import DEFAULT, HVAC_SETTINGS, TIE, hvac

A = "urn:a#"


def graph_rows():
    rng = random.Random(6)
    out = []
    for i in range(12):
        n = f"{A}n{i}"
        out.append((n, RDF_TYPE, iri(A + ("Red" if i % 3 else "Blue"))))
        for _ in range(rng.randint(0, 2)):
            out.append((n, A + "size", Term("lit", str(rng.randint(1, 4)), rng.choice((INTEGER, DECIMAL)))))
        if rng.random() < 0.6:
            out.append((n, A + "next", iri(f"{A}n{rng.randrange(12)}")))
        if rng.random() < 0.5:
            out.append((n, A + "name", Term("lit", rng.choice("xyz"))))
    return list(dict.fromkeys(out))


QUERIES = [
    "SELECT ?s ?v WHERE { ?s a a:Red ; a:size ?v . FILTER (?v > 1 && ?v != 3) }",
    "SELECT ?s ?t WHERE { ?s a:next ?t . ?t a a:Blue . }",
    "SELECT ?s ?p ?o WHERE { ?s ?p ?o . ?s a a:Blue . }",
    "SELECT ?s ?w WHERE { ?s a a:Red . OPTIONAL { ?s a:name ?w . } }",
    'SELECT ?s ?z WHERE { ?s a a:Blue . OPTIONAL { ?z a:name "x" . } }',
    "SELECT ?s ?z WHERE { ?s a a:Blue . OPTIONAL { ?z a a:Green . } }",
    "SELECT ?s WHERE { ?s a a:Red . FILTER EXISTS { ?s a:name ?w . } }",
    "SELECT ?s WHERE { ?s a a:Red . FILTER NOT EXISTS { ?s a:name ?w . } }",
    'SELECT ?s WHERE { ?s a a:Red . FILTER EXISTS { ?z a:name "x" . } }',
    "SELECT ?s WHERE { ?s a a:Red . FILTER EXISTS { ?z a a:Green . } }",
    'SELECT ?s WHERE { ?s a a:Red . FILTER NOT EXISTS { ?z a:name "x" . } }',
    "SELECT ?s WHERE { ?s a a:Red . FILTER NOT EXISTS { ?z a a:Green . } }",
    "SELECT ?s WHERE { ?s a a:Red . MINUS { ?s a:next ?t . } }",
    "SELECT ?s WHERE { ?s a a:Red . MINUS { ?z a a:Blue . } }",
    "SELECT ?s ?v WHERE { { ?s a:size ?v . } UNION { ?s a:name ?v . } }",
    'SELECT ?s ?k WHERE { ?s a a:Blue . BIND ("q" AS ?k) }',
    "SELECT DISTINCT ?v WHERE { ?s a:name ?v . }",
    "SELECT ?s (COUNT(?v) AS ?n) (SUM(?v) AS ?t) (MAX(?v) AS ?m) WHERE { ?s a:size ?v . } GROUP BY ?s",
    "SELECT (MIN(?v) AS ?n) WHERE { ?s a a:Green ; a:size ?v . }",
    "SELECT (GROUP_CONCAT(?v) AS ?g) (SAMPLE(?v) AS ?x) WHERE { ?s a:name ?v . }",
    "SELECT ?s ?t WHERE { ?s a:size ?v . { SELECT (SUM(?w) AS ?t) WHERE { ?q a:size ?w . } } }",
    "SELECT ?s ?t WHERE { ?s a:next/a:next ?t . }",
    "SELECT ?s ?t WHERE { ?s ^a:next ?t . ?s a a:Red . }",
    "SELECT ?s ?v WHERE { ?s a:size|a:name ?v . }",
    "SELECT ?s ?t WHERE { ?s a:next+ ?t . }",
    "SELECT ?s ?t WHERE { ?s a a:Blue . ?s a:next* ?t . }",
    "SELECT ?s ?t WHERE { ?s a a:Blue ; a:next? ?t . }",
    "SELECT ?s ?v WHERE { ?s (a:next/a:next)+/a:size ?v . }",
    "SELECT ?s ?v WHERE { ?s a:size ?v . VALUES ?v { 1 3.0 4 } }",
    'SELECT ?s ?c ?w WHERE { ?s a ?c ; a:name ?w . VALUES (?c ?w) { (a:Red "x") (a:Blue "y") (a:Red "z") } }',
    "SELECT ?s (SUM(?v) AS ?t) WHERE { ?s a:size ?v . } GROUP BY ?s HAVING (?t > 2)",
    "SELECT ?c (COUNT(*) AS ?n) WHERE { ?s a ?c . } GROUP BY ?c HAVING (COUNT(?s) > 5 && MAX(?s) != 3)",
    "SELECT ?s ?v WHERE { ?s a:size ?v . } ORDER BY DESC(?v) ?s LIMIT 3 OFFSET 2",
    "SELECT DISTINCT ?w WHERE { ?s a:name ?w . } ORDER BY ?w OFFSET 1",
    "SELECT ?s ?v WHERE { ?s a:size ?v . FILTER (?v + 1 >= 3 * 1 && -?v < -1) }",
    "SELECT ?s ?k WHERE { ?s a:size ?v . BIND ((?v * 3 - 1) / 4 AS ?k) }",
    'SELECT ?s ?k WHERE { ?s a:name ?w . BIND (CONCAT(UCASE(?w), "-", STR(?s)) AS ?k) }',
    'SELECT ?s ?k WHERE { ?s a:name ?w . BIND (SHA256(?w) AS ?k) FILTER (STRLEN(?w) = 1 && CONTAINS(STR(?s), "n1")) }',
    'SELECT ?s WHERE { ?s a:name ?w . FILTER (REGEX(?w, "^[XY]", "i") || STRENDS(STR(?s), "7")) }',
    'SELECT ?s WHERE { ?s a:name ?w . FILTER (?w IN ("x", "q")) }',
    'SELECT ?s WHERE { ?s a:name ?w . FILTER (?w NOT IN ("x", "q") && !STRSTARTS(?w, "z")) }',
    "SELECT ?s WHERE { ?s a a:Red . OPTIONAL { ?s a:name ?w . } FILTER (!BOUND(?w)) }",
    'SELECT ?s ?k WHERE { ?s a a:Red . OPTIONAL { ?s a:name ?w . } BIND (COALESCE(?w, "none") AS ?k) }',
    'SELECT ?s ?k WHERE { ?s a:size ?v . BIND (IF(?v > 2, "big", "small") AS ?k) }',
    "SELECT ?s ?k WHERE { ?s a:size ?v . BIND (CEIL(?v / 2) + FLOOR(?v / 3) + ROUND(?v / 2) + ABS(-?v) AS ?k) }",
    "SELECT ?s ?p WHERE { ?s ?p ?o . FILTER (ISIRI(?o) && !ISLITERAL(?o)) }",
    'SELECT ?s WHERE { ?s a a:Red . OPTIONAL { ?s a:name ?w . } FILTER (?w != "x") }',
    'SELECT ?s WHERE { ?s a a:Red . OPTIONAL { ?s a:name ?w . } FILTER (?w IN ("x", "y")) }',
    "SELECT ?s ?k WHERE { ?s a:size ?v . BIND (DATATYPE(?v) AS ?k) FILTER (ISNUMERIC(?v)) }",
    'SELECT ?k WHERE { ?s a:name "x" . BIND (YEAR("2026-03-14T09:05:07.5Z") + MONTH("2026-03-14T09:05:07Z") + SECONDS("2026-03-14T09:05:07.5Z") AS ?k) }',
    "SELECT ?s ?k WHERE { ?s a:name ?w . BIND (SUBSTR(STR(?s), 5, 2) AS ?k) }",
]


def shown(term):
    if term is None:
        return None
    number = sparql.as_number(term)
    return str(number.normalize()) if number is not None else (term.kind, term.lex)


@pytest.mark.parametrize("text", QUERIES)
def test_both_evaluators_agree(spark, text):
    rows = graph_rows()
    graph = {}
    for s, p, o in rows:
        graph.setdefault(s, {}).setdefault(p, []).append(o)
    query = sparql.parse(f"PREFIX a: <{A}> {text}")
    names = [n for n, _ in query.columns if not n.startswith("_having")]
    want = [tuple(shown(r.get(n)) for n in names) for r in sparql.solve(query, graph)]
    quads = windowing.state_quads(readers.triples_frame(spark, rows))
    terms = [tuple(None if v is None or v["lex"] is None else Term(v["kind"], v["lex"], v["dt"]) for v in r) for r in sparql.to_frame(quads, query).select(*names).collect()]
    assert sorted([tuple(map(shown, r)) for r in terms], key=str) == sorted(want, key=str)


def test_validators_agree_on_996_states(spark):
    """Each zone is a case of its own: slots missing, doubled, out of range or of a wrong kind."""
    rng = random.Random(8)
    extra = shacl.parse_shapes(f"""
      @prefix sh: <{shacl.SH}> . @prefix b: <{BUILDING}> .
      b:Texts a sh:NodeShape ; sh:targetClass b:HVAC_Zone ; sh:property [ sh:path b:ventilationMode ; sh:pattern "^[a-z]+$" ; sh:minLength 3 ; sh:maxLength 8 ] .
      b:Value a sh:NodeShape ; sh:targetClass b:HVAC_Zone ; sh:property [ sh:path b:occupied ; sh:hasValue false ] .
      b:Open a sh:NodeShape ; sh:targetClass b:HVAC_Zone ; sh:property [ sh:path b:co2Level ; sh:minExclusive 400 ; sh:maxExclusive 1000 ] .""")
    constraints = [c for c in presets.HVAC_SHAPES if c.target_kind == "class"] + extra
    choices = {
        "currentSetpoint": [Term("lit", x, DECIMAL) for x in ("17.9", "18", "20.0", "26", "26.1")] + [Term("lit", "warm")],
        "ventilationMode": [Term("lit", x) for x in ("off", "normal", "high", "emergency", "HIGH", "no", "emergencies")],
        "emergencyState": [Term("lit", "true", BOOLEAN), Term("lit", "false", BOOLEAN), Term("lit", "false")],
        "occupied": [Term("lit", "true", BOOLEAN), Term("lit", "false", BOOLEAN)],
        "co2Level": [Term("lit", x, DECIMAL) for x in ("400", "400.5", "999.9", "1000")],
    }
    rows = []
    for i in range(996):
        zone = f"{BUILDING}Case{i}"
        rows.append((zone, RDF_TYPE, iri(BUILDING + "HVAC_Zone")))
        for slot, values_ in choices.items():
            for o in rng.sample(values_, rng.choice((0, 1, 1, 1, 1, 1, 2))):
                rows.append((zone, BUILDING + slot, o))
    frame = readers.triples_frame(spark, rows)
    _, compiled = shacl.conforms(spark, frame, constraints)
    _, checked = shacl.conforms(spark, frame, constraints, "incremental")
    assert compiled == checked and len({x.split()[1] for x in compiled}) > 800
    some = {f"{BUILDING}Case{i}" for i in range(0, 996, 5)}
    _, focused = shacl.conforms(spark, frame, constraints, "incremental", some)
    assert focused == [x for x in checked if x.split()[1] in some]
    with pytest.raises(ValueError, match="regime"):
        shacl.conforms(spark, frame, constraints, "other")


def test_logic_pairs_and_closed_shapes(spark):
    rng = random.Random(12)
    shapes = shacl.parse_shapes(f"""
      @prefix sh: <{shacl.SH}> . @prefix a: <{A}> .
      a:Kinds a sh:NodeShape ; sh:targetClass a:Red ; sh:property [ sh:path a:next ; sh:nodeKind sh:IRI ; sh:class a:Red ] ; sh:property [ sh:path a:name ; sh:nodeKind sh:Literal ] .
      a:Pairs a sh:NodeShape ; sh:targetClass a:Red ; sh:property [ sh:path a:low ; sh:lessThan a:high ] ; sh:property [ sh:path a:low ; sh:lessThanOrEquals a:size ] ;
        sh:property [ sh:path a:name ; sh:equals a:label ] ; sh:property [ sh:path a:name ; sh:disjoint a:other ] .
      a:Shut a sh:NodeShape ; sh:targetClass a:Blue ; sh:closed true ; sh:ignoredProperties ( <{RDF_TYPE}> a:next ) ; sh:property [ sh:path a:size ; sh:maxCount 1 ] .
      a:Logic a sh:NodeShape ; sh:targetClass a:Red ; sh:or ( [ sh:path a:size ; sh:minInclusive 3 ; sh:minCount 1 ] [ sh:path a:name ; sh:minCount 1 ] ) ;
        sh:not [ sh:path a:label ; sh:hasValue "x" ] ; sh:xone ( [ sh:path a:low ; sh:minCount 1 ] [ sh:path a:high ; sh:minCount 1 ] ) ; sh:and ( [ sh:path a:size ; sh:maxCount 1 ] [ sh:path a:name ; sh:maxCount 1 ] ) .
      a:Some a sh:NodeShape ; sh:targetClass a:Blue ; sh:property [ sh:path a:next ; sh:qualifiedValueShape [ sh:path a:size ; sh:minCount 1 ; sh:minInclusive 2 ] ; sh:qualifiedMinCount 1 ; sh:qualifiedMaxCount 1 ] .""")
    rows = []
    for i in range(200):
        n = f"{A}n{i}"
        rows.append((n, RDF_TYPE, iri(A + rng.choice(("Red", "Blue")))))
        for slot in ("size", "low", "high"):
            rows += [(n, A + slot, Term("lit", str(rng.randint(0, 4)), INTEGER)) for _ in range(rng.choice((0, 1, 1, 2)))]
        for slot in ("name", "label", "other"):
            rows += [(n, A + slot, Term("lit", rng.choice("xy"))) for _ in range(rng.choice((0, 1, 1)))]
        rows += [(n, A + "next", rng.choice((iri(f"{A}n{rng.randrange(200)}"), iri(f"{A}n{rng.randrange(200)}"), Term("lit", "end")))) for _ in range(rng.choice((0, 1, 2)))]
    frame = readers.triples_frame(spark, rows)
    _, compiled = shacl.conforms(spark, frame, shapes)
    _, checked = shacl.conforms(spark, frame, shapes, "incremental")
    assert compiled == checked
    kinds = {x.split(" ", 2)[2].split(": ")[-1] for x in compiled}
    assert kinds >= {"nodeKind", "class", "lessThan", "lessThanOrEquals", "equals", "disjoint", "or", "not", "xone", "and", "qualifiedMinCount", "qualifiedMaxCount", "name", "label"}


def test_files_are_validated(spark, tmp_path):
    (tmp_path / "data.ttl").write_text(f'@prefix b: <{BUILDING}> .\nb:Z a b:HVAC_Zone ; b:currentSetpoint 30.5 .\n')
    (tmp_path / "shapes.ttl").write_text(f"@prefix sh: <{shacl.SH}> . @prefix b: <{BUILDING}> .\nb:S a sh:NodeShape ; sh:targetClass b:HVAC_Zone ; sh:property [ sh:path b:currentSetpoint ; sh:maxInclusive 26 ] .\n")
    for regime in ("shacl", "incremental"):
        ok, lines = shacl.validate_files(spark, str(tmp_path / "data.ttl"), str(tmp_path / "shapes.ttl"), regime)
        assert not ok and len(lines) == 1 and "maxInclusive" in lines[0]
    assert canon.lines(readers.read_turtle(spark, str(tmp_path / "data.ttl"))).count() == 2


def test_json_text_is_that_of_the_identity(spark):
    texts = ["plain", 'q"\\', "é", "\U0001f600 and \U0001d11e", "tab\t\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(values.json_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [json.dumps(t) for t in texts]


def test_context_without_roles_has_the_ranked_ones(spark):
    found = readers.governance({"role_precedence": {"a": 0, "b": 1}, "governance": {"enforce_active_roles": True}}, {"default": {}})
    assert found["active_roles"] == ["a", "b"] and found["principal"] == "automation-engine"
    step = hvac(spark, DEFAULT, settings={"role_precedence": presets.HVAC_RANKS, "governance": {"context_name": "none", "enforce_active_roles": True}})
    assert step.digest().startswith("4bbb205b")


def test_inactive_roles_and_uncapped_roles(spark):
    policy = {BUILDING + "minSetpoint": 18.0, BUILDING + "occupantMaxSetpoint": 23.0}
    guard = lambda v, role: resolution.guard(BUILDING + "currentSetpoint", v, role, policy, HVAC)
    assert guard(10.0, "visitor") == guard(20.0, "visitor") == (True, "policy_guard_not_applicable")
    assert guard(10.0, "occupant") == (False, "policy_min_setpoint_violation:10.0 < 18.0") and guard(20.0, "operator") == (True, "policy_guard_passed")
    step = hvac(spark, TIE)
    refused = resolution.resolve(step.state, step.schedule, presets.HVAC_SHAPES, HVAC, resolution.Options(HVAC.gate_order, active_roles=("occupant",)))
    assert {r.reason for r in refused.collect()} == {"inactive_role"}


def test_last_writer_wins_where_the_conflict_gate_is_off(spark):
    step = hvac(spark, TIE, settings={"role_precedence": presets.HVAC_RANKS, "governance": {"conflict_policy": "last_writer_wins"}})
    assert {r.accepted for r in step.decisions.collect()} == {True}
    direct = resolution.last_writer_wins(step.state, step.schedule, HVAC)
    assert canon.digest(direct) == step.digest()
    orders = {canon.digest(trace.order_only_outcome(step, seed)) for seed in range(6)}
    assert canon.digest(trace.order_only_outcome(step, None)) == step.digest() and len(orders) == 2


def test_tied_actions_have_one_outcome(spark):
    state, tied = synthetic.tied_state(spark), synthetic.tied_actions(spark, 64)
    payload = {"rid": "r_synth_0007", "eid": "synth-evt-0007", "window_id": "urn:window", "predicate": BUILDING + "currentSetpoint", "bindings": {"i": 7}}
    assert tied.where("rid = 'r_synth_0007'").first().aid == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    digests = set()
    for rows in (tied, tied.repartition(5), tied.orderBy(F.desc("aid"))):
        done = resolution.resolve(state, actions.schedule(rows), presets.HVAC_SHAPES, HVAC)
        digests.add(canon.digest(resolution.successor(state, done)))
    assert len(digests) == 1 and digests.pop().startswith("4dc41391")
    shuffled = resolution.resolve(state, actions.tie_random_order(tied, 3), presets.HVAC_SHAPES, HVAC)
    assert shuffled.where("accepted").count() == 1


def test_a_second_resolver_agrees(spark):
    for events in (DEFAULT, TIE):
        step = hvac(spark, events)
        found = crosscheck.agreement(spark, trace.tables(step), step.state, presets.HVAC_SHAPES, HVAC, actions.SCHEDULE_KEY)
        assert found == dict.fromkeys(("schedule", "decisions", "accepted", "digest", "overall_pass"), True)
    tables = trace.tables(step) | {"decisions": step.decisions.withColumn("accepted", F.lit(True))}
    assert not crosscheck.agreement(spark, tables, step.state, presets.HVAC_SHAPES, HVAC, actions.SCHEDULE_KEY)["decisions"]


def test_digests_of_every_decision_and_state_replay(spark, tmp_path):
    step = hvac(spark, [*DEFAULT[:2], {**DEFAULT[5], "eid": "evt-x", "payload": {"zone": BUILDING + "ZoneA", "target": 23.5}}])
    along = canon.digests_along(step.state, step.decisions)
    rows = {r.schedule_index: r for r in along.join(step.decisions, "schedule_index").collect()}
    for r in rows.values():
        assert (r.candidate_graph_digest is not None) == (r.reason in ("admissible", "inadmissible"))
        assert (r.candidate_graph_digest == r.post_graph_digest) == r.accepted and (r.accepted or r.pre_graph_digest == r.post_graph_digest)
    recorded = trace.tables(step)
    recorded["decisions"] = step.decisions.join(along, "schedule_index")
    done = trace.replay_state(recorded, presets.HVAC_SHAPES)
    assert done["step_digest_match"] and done["successor_digest_match"]
    hot = {**recorded, "graph_in": canon.lines(synthetic.primed(step.state, [(BUILDING + "ZoneC", BUILDING + "currentSetpoint", Term("lit", "40.0", DECIMAL))]))}
    with pytest.raises(ValueError, match="inadmissible on replay"):
        trace.replay_state(hot, presets.HVAC_SHAPES)
    subject = canon.subject_digests_along(step.state, step.decisions)
    assert subject.count() == step.decisions.count()
    trace.write_document(spark, trace.document(step, presets.HVAC_RULES, digests=True), str(tmp_path / "trace.json"))
    held = readers.read_trace(str(tmp_path / "trace.json"))
    assert held["summary"]["enabled_count"] == len(held["decisions"]) and list(held) == sorted(held)
    trace.write_rows(spark, [{"n": 1, "ms": 2.5}, {"n": 2, "ms": 3.5}], str(tmp_path / "r.csv"))
    assert list(csv.DictReader((tmp_path / "r.csv").open())) == [{"n": "1", "ms": "2.5"}, {"n": "2", "ms": "3.5"}]
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "r.csv"), "n int, ms double").collect()] == [(1, 2.5), (2, 3.5)]


def test_shared_budget_and_single_window(spark):
    events = readers.events_frame(spark, [{"eid": f"e{i}", "timestamp": "2026-03-14T09:00:00Z", "type": "ChargeRequest", "role": "driver", "payload": {"cp": f"http://example.org/ev#CP{i}", "power": 22}} for i in (1, 2, 3)])
    settings = {"role_precedence": presets.EV_RANKS, "window": {"type": "single", "window_id": "ev:single-window"}}
    step = run_step(spark, presets.ev_state(spark), events, presets.EV_RULES, presets.shared_budget_shapes(), settings, None, domain=EV)
    assert step.window["window_id"] == "ev:single-window" and step.decisions.where("accepted").count() == 2


def test_modes_agree_where_constraints_are_local(spark):
    rng = random.Random(3)
    zones = synthetic.zone_state(spark, 6)
    kinds = (("DemandResponsePeak", "operator", "cap"), ("PreheatRequest", "operator", "target"), ("OccupantSetpointRequest", "occupant", "delta"), ("CO2Spike", "operator", "mode"), ("EmergencyAlarm", "emergency", "state"))
    events = []
    for i in range(60):
        kind, role, key = rng.choice(kinds)
        value = {"mode": rng.choice(("high", "odd")), "state": True}.get(key, rng.choice((1, 17, 21, 25, 30)))
        events.append({"eid": f"e{i:03d}", "timestamp": f"2026-03-14T09:00:{i % 60:02d}Z", "type": kind, "role": role, "payload": {"zone": f"{BUILDING}ScaleZone{rng.randrange(6):05d}", key: value}})
    step = run_step(spark, zones, readers.events_frame(spark, events), presets.HVAC_RULES, presets.HVAC_SHAPES, HVAC_SETTINGS, presets.HVAC_CONTEXTS)
    both = [resolution.resolve(step.state, step.schedule, presets.HVAC_SHAPES, HVAC, mode=m).select("schedule_index", "accepted", "reason", "blocked_by_aid") for m in ("zone", "global")]
    rows = [sorted(map(tuple, b.collect()), key=str) for b in both]
    assert rows[0] == rows[1] and len({r[2][:8] for r in rows[0]}) >= 3


def test_checks_of_the_fold_are_dealt_out(spark):
    """Local constraints by subject, the others whole: what they find in one graph in memory."""
    shapes = shacl.parse_shapes(f"""
      @prefix sh: <{shacl.SH}> . @prefix a: <{A}> .
      a:Size a sh:NodeShape ; sh:targetClass a:Red ; sh:property [ sh:path a:size ; sh:minCount 1 ; sh:maxInclusive 2 ; sh:lessThan a:high ] .
      a:There a sh:NodeShape ; sh:targetNode a:n3, a:nowhere ; sh:property [ sh:path a:size ; sh:minCount 1 ] .
      a:Shut a sh:NodeShape ; sh:targetClass a:Blue ; sh:closed true ; sh:property [ sh:path a:size ; sh:maxCount 1 ] .
      a:Logic a sh:NodeShape ; sh:targetClass a:Blue ; sh:not [ sh:path a:high ; sh:minCount 1 ] .
      a:Own a sh:NodeShape ; sh:targetClass a:Red ; sh:sparql [ sh:message "named" ; sh:select "PREFIX a: <{A}> SELECT $this WHERE {{ $this ?p ?name . FILTER (?name = \\"x\\") }}" ] .
      a:Next a sh:NodeShape ; sh:targetClass a:Red ; sh:property [ sh:path a:next ; sh:class a:Red ] .""")
    assert [c.shape for c in shapes if not c.local] == [A + "Next"]
    rng, rows = random.Random(4), []
    for i in range(300):
        n = f"{A}n{i}"
        rows.append((n, RDF_TYPE, iri(A + rng.choice(("Red", "Blue")))))
        rows += [(n, A + slot, Term("lit", str(rng.randint(0, 4)), INTEGER)) for slot in ("size", "high") for _ in range(rng.choice((0, 1, 2)))]
        rows += [(n, A + "name", Term("lit", rng.choice("xy"))), (n, A + "next", iri(f"{A}n{rng.randrange(300)}"))]
    graph: dict = {}
    for s, p, o in dict.fromkeys(rows):
        graph.setdefault(s, {}).setdefault(p, []).append(o)
    state, some = readers.triples_frame(spark, rows), {f"{A}n{i}" for i in range(0, 300, 7)}
    for chosen in (shapes, [c for c in shapes if c.local], [c for c in shapes if c.shape == A + "Size"]):
        for focus in (None, some):
            want = sorted(shacl.faults(graph, chosen, focus))
            assert sorted(r.line for r in shacl.fault_lines(state, chosen, focus).collect()) == want and want
    assert {x.split()[0].removeprefix(A) for x in shacl.faults(graph, shapes)} == {"Size", "There", "Shut", "Logic", "Own", "Next"}
    lines = shacl.fault_lines(state, shapes)
    want = "\n".join(sorted(shacl.faults(graph, shapes)))
    twice = lines.union(lines)
    assert tuple(shacl.report_row(lines).first()) == (False, want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # lines repeat beyond a piece
    try:
        assert shacl.report_row(twice).first().report == "\n".join(x for line in want.split("\n") for x in (line, line))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(shacl.report_row(lines.limit(0)).first()) == (True, None)


def test_validation_report_is_made_by_executors(spark, monkeypatch):
    from edictum.plans import catalog

    monkeypatch.setattr(type(spark.range(0)), "collect", None)
    monkeypatch.setattr(type(spark.range(0)), "toArrow", None)
    found = catalog.QUERIES["validation_report"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["conforms", "report"]


def test_products_are_whole_and_small_in_files(spark, tmp_path):
    def side(name: str, n: int):
        return spark.range(n).select(F.struct(F.lit("iri").alias("kind"), F.concat(F.lit(f"urn:{name}:"), F.col("id") * 7919).alias("lex")).alias(name)).repartition(2, name)

    left, right = side("x", 400), side("y", 6000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = {}
        for name, frame in (("plain", left.crossJoin(right)), ("joined", sparql._join(left, right))):
            path = tmp_path / name
            frame.select("x.lex", F.col("y.lex").alias("other")).write.parquet(str(path))
            sizes[name] = sum(f.stat().st_size for f in path.glob("*.parquet"))
        assert 3 * sizes["joined"] < sizes["plain"]
        assert spark.read.parquet(str(tmp_path / "joined")).exceptAll(spark.read.parquet(str(tmp_path / "plain"))).count() == 0
        assert spark.read.parquet(str(tmp_path / "joined")).count() == 400 * 6000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert sparql._join(a, b).columns == ["x", "y"] and sparql._join(a, b).count() == 0
    assert sparql._join(left.select(), right.limit(5)).count() == 2000 and sparql._join(left.limit(5), right.select()).count() == 30000


def test_conditions_write_the_quads_that_they_name(spark, monkeypatch):
    from edictum.plans import step_queries

    def named(text: str):
        return sparql.predicates(sparql.parse("PREFIX a: <urn:acc:> SELECT * WHERE { " + text + " }"))

    assert named("?s a:x ?o ; a a:Zone . OPTIONAL { ?s a:y/^a:z ?o } FILTER NOT EXISTS { ?s a:w+ ?o }") == {RDF_TYPE, *[f"urn:acc:{c}" for c in "xyzw"]}
    assert named("{ ?s a:x 1 } UNION { SELECT ?s WHERE { GRAPH <urn:g> { ?s a:y|a:z ?o } } } MINUS { ?s a:w 2 } FILTER (?o > 3)") == {f"urn:acc:{c}" for c in "xyzw"}
    assert named("?s a:x ?o . FILTER EXISTS { ?s ?p 1 }") is None and named("?s a:x* ?o") is None and named("?s (a:x/a:y?)+ ?o") is None
    held, whole = [], step_queries.written
    monkeypatch.setattr(step_queries, "written", lambda df, name: held.append(whole(df, name)) or held[-1])
    made = step_queries.event_state_cross(spark, "/root/testdata/sf0.001")
    assert {r.p for r in held[0].select("p").distinct().collect()} == {RDF_TYPE, "urn:acc:segment", "urn:prop:type", "urn:prop:eid", "urn:prop:cents"}
    monkeypatch.setattr(step_queries.sparql, "predicates", lambda query: None)
    every = step_queries.event_state_cross(spark, "/root/testdata/sf0.001")
    assert made.count() == every.count() > 0 and made.exceptAll(every).isEmpty()
