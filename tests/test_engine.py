"""Worked steps of both applications: decisions, reasons, and digests of the next state."""

import json

import pytest
from pyspark.sql import functions as F

from edictum.operators import canon, resolution, shacl, windowing
from edictum.plans import presets, trace
from edictum.plans.engine import run_step
from edictum.sources import readers, synthetic
from edictum.sources.domain import BUILDING, CHARGING, EV
from edictum.sources.store import Crash, DuplicateStep, StepStore, step_id
from edictum.sources.terms import DECIMAL, Term
from edictum.streaming import steps as stream

NINE = "2026-03-14T09:00:00Z"
HVAC_SETTINGS = {"role_precedence": presets.HVAC_RANKS}


def event(eid, kind, role, at=NINE, **payload):
    for k in ("zone", "cp", "feeder"):
        if k in payload:
            payload[k] = (BUILDING if k == "zone" else CHARGING) + payload[k]
    return {"eid": eid, "timestamp": at, "type": kind, "role": role, "payload": payload}


DEFAULT = [
    event("evt-001", "OccupantSetpointRequest", "occupant", zone="ZoneA", delta=2),
    event("evt-002", "DemandResponsePeak", "operator", zone="ZoneA", cap=21),
    event("evt-003", "CO2Spike", "operator", zone="ZoneC", mode="high"),
    event("evt-004", "OccupancyDetected", "occupant", zone="ZoneB"),
    event("evt-005", "EmergencyAlarm", "emergency", zone="ZoneC", state=True),
    event("evt-006", "PreheatRequest", "operator", zone="ZoneB", target=22),
]
TIE = [event("tie-demand-001", "DemandResponsePeak", "operator", zone="ZoneB", cap=21), event("tie-preheat-001", "PreheatRequest", "operator", zone="ZoneB", target=22)]


def hvac(spark, events, state=None, **more):
    start = presets.hvac_state(spark) if state is None else state
    settings = more.pop("settings", HVAC_SETTINGS)
    return run_step(spark, start, readers.events_frame(spark, events), presets.HVAC_RULES, presets.HVAC_SHAPES, settings, presets.HVAC_CONTEXTS, **more)


def decided(step):
    return [tuple(r) for r in step.decisions.orderBy("schedule_index").select("rid", "accepted", "reason").collect()]


def test_default_step(spark):
    state = presets.hvac_state(spark)
    assert canon.digest(state).startswith("fed729ff")
    step = hvac(spark, DEFAULT)
    found = decided(step)
    assert [r for r, ok, _ in found if ok] == ["r6", "r5", "r2", "r7", "r8"]
    assert [(r, why) for r, ok, why in found if not ok] == [
        ("r3", "shadowed_by_prior_accepted_action"),
        ("r1", "policy_role_cap_violation:occupant:24.0 > 23.0"),
        ("r4", "shadowed_by_prior_accepted_action"),
    ]
    assert step.digest().startswith("4bbb205b")


def test_identity_window_and_replay(spark, tmp_path):
    step = hvac(spark, TIE)
    assert step.window["window_id"] == "sliding:2026-03-14T08:55:00+00:00::2026-03-14T09:00:00+00:00"
    aids = [r.aid for r in step.schedule.orderBy("schedule_index").collect()]
    assert [a[:8] for a in aids] == ["163e544e", "00b8a313", "ef589562"]
    assert step.digest().startswith("ecf5860a")
    along = {r.schedule_index: r.post_graph_digest[:8] for r in canon.digests_along(step.state, step.decisions).collect()}
    assert along == {0: "06e96c53", 1: "06e96c53", 2: "ecf5860a"}
    trace.write_tables(step, str(tmp_path / "t"))
    recorded = trace.read_tables(spark, str(tmp_path / "t"))
    again = trace.replay_full(spark, recorded, presets.HVAC_RULES, presets.HVAC_SHAPES, HVAC_SETTINGS, presets.HVAC_CONTEXTS, NINE)
    assert again["overall_pass"] and again["first_difference"] is None
    recorded["decisions"] = recorded["decisions"].withColumn("reason", F.when(F.col("schedule_index") == 1, "changed").otherwise(F.col("reason")))
    broken = trace.compare(recorded, trace.tables(step))
    assert not broken["overall_pass"] and broken["first_difference"]["schedule_index"] == 1
    doc = trace.document(step, presets.HVAC_RULES)
    assert doc["summary"]["accepted_count"] == 2 and doc["input_graph"]["triple_count"] == 23


def test_precedence_turned_round(spark):
    events = [event("gov-occ-001", "OccupantSetpointRequest", "occupant", zone="ZoneB", delta=2), event("gov-op-001", "DemandResponsePeak", "operator", zone="ZoneB", cap=21)]
    assert hvac(spark, events).digest().startswith("ecf5860a")
    step = hvac(spark, events, settings={"role_precedence": {"occupant": 0, "operator": 1, "emergency": 2}})
    assert step.digest().startswith("e96ca3bd")


def test_inadmissible_start_folds_globally(spark):
    hot = canon.apply_writes(presets.hvac_state(spark), readers.triples_frame(spark, [(BUILDING + "ZoneA", BUILDING + "currentSetpoint", Term("lit", "25.0", DECIMAL))]))
    ok, lines = shacl.report(hot, presets.HVAC_SHAPES)
    assert not ok and "maxInclusive" in lines[0]
    step = hvac(spark, DEFAULT, hot)
    assert sorted(r for r, ok, _ in decided(step) if ok) == ["r2", "r3", "r7", "r8"]
    assert step.digest().startswith("1ac8a213")


def test_cross_target_budget(spark):
    events = [event(f"ev-00{i}", "ChargeRequest", "driver", cp=f"CP{i}", power=22) for i in (1, 2, 3)]
    step = run_step(spark, presets.ev_state(spark), readers.events_frame(spark, events), presets.EV_RULES, presets.EV_SHAPES, {"role_precedence": presets.EV_RANKS}, None, domain=EV)
    assert decided(step) == [("q1", True, "admissible"), ("q1", True, "admissible"), ("q1", False, "inadmissible")]
    assert step.digest().startswith("fbca9dfa")
    emergency = readers.events_frame(spark, [event("em-1", "GridEmergency", "grid", feeder="Feeder1")])
    after = run_step(spark, step.successor, emergency, presets.EV_RULES, presets.EV_SHAPES, {"role_precedence": presets.EV_RANKS}, None, domain=EV)
    assert [r for r, ok, _ in decided(after) if ok] == ["q5"] * 4 + ["q4"]
    assert after.digest().startswith("fb842cb2")


def test_generated_zones(spark):
    step = run_step(spark, synthetic.zone_state(spark, 10), synthetic.requests(spark, 10), presets.HVAC_RULES, presets.HVAC_SHAPES, HVAC_SETTINGS, presets.HVAC_CONTEXTS)
    assert step.digest().startswith("67d43a67")
    one_zone = hvac(spark, DEFAULT)
    both = [resolution.resolve(one_zone.state, one_zone.schedule, presets.HVAC_SHAPES, resolution_domain(), mode=m).select("schedule_index", "reason").collect() for m in ("zone", "global")]
    assert sorted(both[0]) == sorted(both[1])


def resolution_domain():
    from edictum.sources.domain import HVAC

    return HVAC


def test_steps_ledger_and_recovery(spark, tmp_path):
    log = readers.events_frame(spark, [event("occ-1", "OccupancyDetected", "occupant", "2026-03-14T09:03:00Z", zone="ZoneB")])
    anchors = ["2026-03-14T09:04:00Z", "2026-03-14T09:06:00Z"]
    fired = {}
    for mode in ("redelivery", "consume_once"):
        store = StepStore(spark, str(tmp_path / mode))
        steps = stream.run_anchors(spark, presets.hvac_state(spark), log, anchors, presets.HVAC_RULES, presets.HVAC_SHAPES, HVAC_SETTINGS, presets.HVAC_CONTEXTS, store, mode)
        fired[mode] = sum(store.decisions(f"anchor-{i:05d}").where("accepted").count() for i in range(2))
        assert store.current() == "anchor-00001" and store.verify()["consistent"]
        if mode == "consume_once":
            assert steps[1].window["window_id"] == "empty"
    assert fired == {"redelivery": 2, "consume_once": 1}
    with pytest.raises(DuplicateStep):
        store.commit_state(steps[0].successor, steps[0].decisions, "anchor-00000")
    for at in ("after_trace", "before_pointer"):
        with pytest.raises(Crash):
            store.commit_state(steps[0].successor, steps[0].decisions, f"crash-{at}", crash_at=at)
    assert store.recover(history=True)["discarded"] == ["crash-after_trace", "crash-before_pointer"]
    assert store.recover() == {"committed": "anchor-00001", "discarded": ["anchor-00000"], "verification": {"consistent": True, "reason": "verified", "step": "anchor-00001"}}
    late = stream.late(log.withColumn("arrival_step", F.lit(9)), anchors, 5)
    assert late.count() == 1


def test_streamed_steps(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(e | {"payload": {k: str(v) for k, v in e["payload"].items()}}) for e in TIE) + "\n\n")
    store = StepStore(spark, str(tmp_path / "store"))
    args = (presets.hvac_state(spark), presets.HVAC_RULES, presets.HVAC_SHAPES, HVAC_SETTINGS, presets.HVAC_CONTEXTS, store, str(tmp_path / "ck"))
    stream.stream_steps(readers.stream_events(spark, str(folder)), *args).awaitTermination(120)
    assert canon.digest(store.current_state(spark)).startswith("ecf5860a")


POINTS = ("after_trace", "after_state", "after_digest", "before_pointer", "after_pointer")


def _write_log(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e | {"payload": {k: str(v) for k, v in e["payload"].items()}}) for e in events) + "\n")


@pytest.mark.parametrize("point", POINTS)
def test_a_crashed_batch_is_applied_once(spark, tmp_path, point):
    """A crash at any write of a batch's commit, then a restart of the stream from its checkpoint."""
    _write_log(tmp_path / "log", "a.json", TIE)
    store = StepStore(spark, str(tmp_path / "store"))
    whole, crashes = store.commit_state, [point]
    store.commit_state = lambda *a, **k: whole(*a, **k, crash_at=crashes.pop() if crashes else None)
    args = (presets.hvac_state(spark), presets.HVAC_RULES, presets.HVAC_SHAPES, HVAC_SETTINGS, presets.HVAC_CONTEXTS, store, str(tmp_path / "ck"))
    with pytest.raises(Exception, match=point):
        stream.stream_steps(readers.stream_events(spark, str(tmp_path / "log")), *args).awaitTermination(120)
    found = store.recover(history=True)
    assert found["verification"]["consistent"] and (found["committed"] is None) == (point != "after_pointer")
    stream.stream_steps(readers.stream_events(spark, str(tmp_path / "log")), *args).awaitTermination(120)
    assert canon.digest(store.current_state(spark)).startswith("ecf5860a") and store.pointer()["count"] == 1


def test_streamed_late_events_and_ledger(spark, tmp_path):
    old = event("old-1", "OccupancyDetected", "occupant", "2026-03-14T08:00:00Z", zone="ZoneB")
    _write_log(tmp_path / "log", "a.json", [*TIE, old])
    store = StepStore(spark, str(tmp_path / "store"))
    args = (presets.hvac_state(spark), presets.HVAC_RULES, presets.HVAC_SHAPES, HVAC_SETTINGS, presets.HVAC_CONTEXTS, store, str(tmp_path / "ck"))
    log = readers.stream_events(spark, str(tmp_path / "log"))
    stream.stream_steps(log, *args, mode="consume_once").awaitTermination(120)
    _write_log(tmp_path / "log", "b.json", TIE)
    stream.stream_steps(log, *args, mode="consume_once").awaitTermination(120)
    assert [r.eid for r in store.kept(spark, "late-*", "eid string").collect()] == ["old-1"]
    # tie-demand-001 was used up; the shadowed request comes again and is accepted in its own window.
    assert sorted(r.eid for r in store.kept(spark, "used-*", "eid string").collect()) == ["tie-demand-001", "tie-preheat-001"]


def test_step_ids(spark, tmp_path):
    state = presets.hvac_state(spark)
    step = hvac(spark, DEFAULT)
    store = StepStore(spark, str(tmp_path / "store"))
    name = store.commit_window(canon.digest(state), step.window["window_id"], step.successor, step.decisions)
    assert name == step_id(canon.digest(state), step.window["window_id"]) == "fae2faf51d0f02e4a9b118a5f915231f"
    with pytest.raises(DuplicateStep):
        store.commit_window(canon.digest(state), step.window["window_id"], step.successor, step.decisions)


def test_windows_and_ids(spark):
    log = readers.events_frame(spark, [event(f"e{m}", "CO2Spike", "operator", f"2026-03-14T09:0{m}:00Z", zone="ZoneA", mode="high") for m in range(8)])
    kept, meta = windowing.select_window(log, {"type": "sliding", "length_minutes": 5}, "2026-03-14T09:05:00Z")
    assert [r.eid for r in kept.orderBy("ordinal").collect()] == [f"e{m}" for m in range(6)]
    kept, meta = windowing.select_window(log, {"type": "tumbling", "length_minutes": 2, "step_minutes": 2}, "2026-03-14T09:05:00Z")
    assert [r.eid for r in kept.orderBy("ordinal").collect()] == ["e4", "e5"] and meta["window_end"].endswith("09:06:00+00:00")
    assert windowing.select_window(log, {"type": "all"})[0].count() == 8
    assert step_id("a", "b") != step_id("a", "c")


def test_ntriples_round_trip(spark):
    state = readers.triples_frame(spark, [("urn:a", "urn:p", Term("lit", 'x "y"\n\\z')), ("urn:a", "urn:q", Term("iri", "urn:b")), ("urn:a", "urn:r", Term("lit", "1.0", DECIMAL))])
    back = readers.parse_ntriples(canon.lines(state))
    assert canon.digest(back) == canon.digest(state)
    removed, inserted = canon.delta(state, back.where("p <> 'urn:q'"))
    assert removed.count() == 1 and inserted.count() == 0
