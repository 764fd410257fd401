"""What an application domain fixes: payload typing, write typing, policy and gate order."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Domain:
    base: str
    numeric_keys: tuple[str, ...]
    iri_keys: tuple[str, ...]
    boolean_keys: tuple[str, ...] = ()
    decimal_predicates: tuple[str, ...] = ()
    boolean_predicates: tuple[str, ...] = ()
    subject_var: str = "zone"
    subject_by_predicate: tuple[tuple[str, str], ...] = ()
    guarded: str = ""  # the predicate that the policy node bounds
    minimum: str = ""
    maximum: str = ""  # appended to a role's name
    minimum_reason: str = ""
    capped_roles: tuple[str, ...] = ()  # roles whose values the policy node bounds at all
    gate_order: tuple[str, ...] = ("role", "policy", "conflict", "admissibility")


# Names that the two applications' data use.
BUILDING = "http://example.org/building#"
CHARGING = "http://example.org/ev#"

HVAC = Domain(
    base=BUILDING,
    numeric_keys=("delta", "cap", "target"),
    iri_keys=("zone",),
    boolean_keys=("state",),
    decimal_predicates=(BUILDING + "currentSetpoint", BUILDING + "co2Level"),
    boolean_predicates=(BUILDING + "emergencyState",),
    guarded=BUILDING + "currentSetpoint",
    minimum=BUILDING + "minSetpoint",
    maximum="MaxSetpoint",
    minimum_reason="policy_min_setpoint_violation",
    capped_roles=("occupant", "operator", "emergency"),
)

EV = Domain(
    base=CHARGING,
    numeric_keys=("power", "cap"),
    iri_keys=("cp", "feeder"),
    decimal_predicates=(CHARGING + "chargingPower",),
    subject_var="cp",
    subject_by_predicate=((CHARGING + "feederState", "feeder"),),
    guarded=CHARGING + "chargingPower",
    minimum=CHARGING + "minPower",
    maximum="MaxPower",
    minimum_reason="policy_min_power_violation",
    capped_roles=("driver", "fleet", "grid"),
    gate_order=("conflict", "policy", "admissibility"),
)
