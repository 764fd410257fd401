"""The two applications, building climate and vehicle charging, as ready settings.

Rules are generated from a table of what they look at; states and shapes are small tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from edictum.operators.shacl import Constraint
from edictum.sources.domain import BUILDING, CHARGING
from edictum.sources.readers import triples_frame
from edictum.sources.terms import BOOLEAN, DECIMAL, RDF_TYPE, Term, iri


def rule(base: str, rid: str, priority: int, role: str, event: str, writes: str, expr: dict, node: str, cls: str, payload: tuple = (), reads: str = "", also: str = "", joined: bool = True) -> dict:
    """A rule: an event of a type, its payload variables, and a typed node's slots.

    ``reads`` is the variable for the written slot if the value or the bindings need it;
    without it the slot must only be there.  ``joined`` ties the node to the event.
    """
    shown = " ".join(f"?{v}" for v in ("e", "eid", "ts", node, *([reads] if reads else []), *payload))
    keys = ((node,) if joined else ()) + payload
    window = f'?e <urn:prop:type> "{event}" ; <urn:prop:eid> ?eid ; <urn:prop:timestamp> ?ts' + "".join(f" ; <urn:prop:{k}> ?{k}" for k in keys)
    state = f"?{node} a ex:{cls} ; ex:{writes} ?{reads or 'any'}" + (f" ; {also}" if also else "")
    return {
        "rid": rid,
        "priority": priority,
        "issuing_role": role,
        "condition_select": f"PREFIX ex: <{base}> SELECT {shown} WHERE {{ GRAPH <urn:window> {{ {window} . }} GRAPH <urn:state> {{ {state} . }} }}",
        "insert_template": {"predicate": base + writes, "value_expr": expr},
    }


def copied(var: str) -> dict:
    return {"kind": "copy", "var": var}


def fixed(value: object) -> dict:
    return {"kind": "literal", "value": value}


def _zone_rule(rid, priority, role, event, writes, expr, **more):
    return rule(BUILDING, rid, priority, role, event, writes, expr, "zone", "HVAC_Zone", **more)


# Rule names, priorities, roles, events and slots of the two applications.
HVAC_RULES = [
    _zone_rule("r1", 2, "occupant", "OccupantSetpointRequest", "currentSetpoint", {"kind": "numeric_add", "left": "setpoint", "right": "delta"}, payload=("delta",), reads="setpoint"),
    _zone_rule("r2", 1, "operator", "DemandResponsePeak", "currentSetpoint", copied("cap"), payload=("cap",), reads="setpoint"),
    _zone_rule("r3", 1, "operator", "CO2Spike", "ventilationMode", copied("mode"), payload=("mode",)),
    _zone_rule("r4", 2, "occupant", "OccupancyDetected", "currentSetpoint", {"kind": "numeric_add_constant", "var": "setpoint", "constant": 1}, reads="setpoint", also="ex:occupied false"),
    _zone_rule("r5", 1, "emergency", "EmergencyAlarm", "emergencyState", copied("state"), payload=("state",)),
    _zone_rule("r6", 0, "emergency", "EmergencyAlarm", "ventilationMode", fixed("emergency")),
    _zone_rule("r7", 1, "operator", "PreheatRequest", "currentSetpoint", copied("target"), payload=("target",), reads="setpoint"),
    _zone_rule("r8", 1, "operator", "DemandResponsePeak", "ventilationMode", fixed("off")),
]


def _point_rule(rid, priority, role, event, writes, expr, **more):
    return rule(CHARGING, rid, priority, role, event, writes, expr, "cp", "ChargingPoint", **more)


# Fixed values of the applications' data.
EV_RULES = [
    _point_rule("q1", 1, "driver", "ChargeRequest", "chargingPower", copied("power"), payload=("power",)),
    _point_rule("q2", 1, "fleet", "FleetSchedule", "chargingPower", copied("power"), payload=("power",)),
    _point_rule("q3", 0, "grid", "CapacitySignal", "chargingPower", copied("cap"), payload=("cap",)),
    rule(CHARGING, "q4", 1, "grid", "GridEmergency", "feederState", fixed("curtailed"), "feeder", "Feeder"),
    _point_rule("q5", 0, "grid", "GridEmergency", "chargingPower", fixed(5), joined=False),
    _point_rule("q6", 1, "driver", "PlugIn", "connectorState", fixed("occupied")),
    _point_rule("q7", 1, "fleet", "DepartureSoon", "chargingPower", fixed(22)),
    _point_rule("q8", 1, "fleet", "FaultDetected", "connectorState", fixed("outOfService")),
]

# Fixed values of the applications' data.
HVAC_RANKS = {"emergency": 0, "operator": 1, "occupant": 2}
EV_RANKS = {"grid": 0, "fleet": 1, "driver": 2}
HVAC_CONTEXTS = {"default": {"principal": "automation-engine", "active_roles": list(HVAC_RANKS), "role_rank": dict(HVAC_RANKS)}}


def _number(text: str) -> Term:
    return Term("lit", text, DECIMAL)


# Fixed values of the applications' data.
def hvac_triples() -> list[tuple[str, str, Term]]:
    b = BUILDING
    out = []
    for zone, setpoint, occupied, co2 in (("ZoneA", "22", "true", "750"), ("ZoneB", "20", "false", "500"), ("ZoneC", "21", "true", "1200")):
        out += [
            (b + zone, RDF_TYPE, iri(b + "HVAC_Zone")),
            (b + zone, b + "currentSetpoint", _number(setpoint)),
            (b + zone, b + "occupied", Term("lit", occupied, BOOLEAN)),
            (b + zone, b + "co2Level", _number(co2)),
            (b + zone, b + "ventilationMode", Term("lit", "normal")),
            (b + zone, b + "emergencyState", Term("lit", "false", BOOLEAN)),
        ]
    out.append((b + "Policy", RDF_TYPE, iri(b + "ControlPolicy")))
    out += [(b + "Policy", b + k, _number(v)) for k, v in (("occupantMaxSetpoint", "23"), ("operatorMaxSetpoint", "24"), ("emergencyMaxSetpoint", "26"), ("minSetpoint", "18"))]
    return out


# Fixed values of the applications' data.
def ev_triples() -> list[tuple[str, str, Term]]:
    b = CHARGING
    out = []
    for i in range(1, 5):
        out += [(f"{b}CP{i}", RDF_TYPE, iri(b + "ChargingPoint")), (f"{b}CP{i}", b + "chargingPower", _number("0")), (f"{b}CP{i}", b + "connectorState", Term("lit", "free"))]
    out += [(b + "Feeder1", RDF_TYPE, iri(b + "Feeder")), (b + "Feeder1", b + "feederState", Term("lit", "normal")), (b + "Feeder1", b + "feederBudget", _number("50"))]
    out.append((b + "Policy", RDF_TYPE, iri(b + "ControlPolicy")))
    out += [(b + "Policy", b + k, _number(v)) for k, v in (("driverMaxPower", "22"), ("fleetMaxPower", "22"), ("gridMaxPower", "22"), ("minPower", "0"))]
    return out


def hvac_state(spark: SparkSession) -> DataFrame:
    return triples_frame(spark, hvac_triples())


def ev_state(spark: SparkSession) -> DataFrame:
    return triples_frame(spark, ev_triples())


def _slot(base: str, shape: str, cls: str, path: str, low: str | None = None, high: str | None = None, values: tuple = (), datatype: str | None = None) -> Constraint:
    bounds = {k: Decimal(v) for k, v in (("minInclusive", low), ("maxInclusive", high)) if v is not None}
    return Constraint(base + shape, "class", base + cls, base + path, 1, 1, bounds, [Term("lit", v) for v in values] or None, datatype)


def _when(base: str, shape: str, kind: str, target: str, pattern: str, message: str) -> Constraint:
    return Constraint(base + shape, kind, base + target, select=f"PREFIX ex: <{base}> SELECT $this WHERE {{ {pattern} }}", message=message)


# Fixed values of the applications' data.
HVAC_SHAPES = [
    _slot(BUILDING, "ZoneSetpointShape", "HVAC_Zone", "currentSetpoint", "18", "26"),
    _slot(BUILDING, "ZoneVentilationShape", "HVAC_Zone", "ventilationMode", values=("off", "normal", "high", "emergency")),
    _slot(BUILDING, "EmergencyStateShape", "HVAC_Zone", "emergencyState", datatype=BOOLEAN),
    Constraint(BUILDING + "ZoneAComfortCapShape", "node", BUILDING + "ZoneA", BUILDING + "currentSetpoint", bounds={"maxInclusive": Decimal(23)}),
    _when(BUILDING, "ZoneAEmergencyVentShape", "node", "ZoneA", '$this ex:ventilationMode "off" . $this ex:currentSetpoint ?now . FILTER (?now > 21)', "ZoneA is above 21 while its ventilation is off."),
    _when(BUILDING, "EmergencyVentLockShape", "class", "HVAC_Zone", '$this ex:emergencyState true . $this ex:ventilationMode ?now . FILTER (?now != "emergency")', "An emergency needs emergency ventilation."),
]

# Fixed values of the applications' data.
EV_SHAPES = [
    _slot(CHARGING, "ChargingPowerShape", "ChargingPoint", "chargingPower", "0", "22"),
    _slot(CHARGING, "ConnectorStateShape", "ChargingPoint", "connectorState", values=("free", "occupied", "charging", "outOfService")),
    _slot(CHARGING, "FeederStateShape", "Feeder", "feederState", values=("normal", "curtailed")),
    _when(
        CHARGING, "FeederBudgetShape", "node", "Feeder1",
        "{ SELECT (SUM(?kw) AS ?all) WHERE { ?point a ex:ChargingPoint . ?point ex:chargingPower ?kw . } } $this ex:feederBudget ?most . FILTER (?all > ?most)",
        "The points together draw more than the feeder's budget.",
    ),
    _when(
        CHARGING, "CurtailmentConsistencyShape", "node", "Feeder1",
        '$this ex:feederState "curtailed" . ?point a ex:ChargingPoint . ?point ex:chargingPower ?kw . FILTER (?kw > 5)',
        "A point draws more than 5 kW from a curtailed feeder.",
    ),
]


def shared_budget_shapes() -> list[Constraint]:
    """A cap for each point and a budget for all of them, for generated charging states."""
    return [EV_SHAPES[0], EV_SHAPES[3]]
