"""The resolution fold inside Catalyst, for entities with a fixed set of slots.

Where every entity has the same few single-valued slots, a component's state is one struct
and the fold is ``aggregate`` over the entity's actions in schedule order: no Python, no
row leaves the JVM.  Gates that look at the action alone (role, policy) are computed as
columns before the fold; the conflict gate and the constraints look at the accumulator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_slots(
    actions: DataFrame,
    state: DataFrame,
    key: str,
    slots: dict[str, str],
    order: list[str],
    admissible: Callable[[dict[str, Column]], Column],
    conflict: bool = True,
) -> DataFrame:
    """One row per entity with actions: ``key``, the slots after the fold, and ``decisions``.

    ``actions`` has ``key``, ``order``, ``id``, ``slot``, ``refused`` (null, or the reason of a
    gate before the fold) and a value column ``to_<slot>`` per slot.  ``state`` has ``key`` and
    the slots; ``slots`` maps them to SQL types.
    """
    fields = [*order, "id", "slot", "refused", *[f"to_{s}" for s in slots]]
    # Leading fields are the schedule key, so sorting the structs sorts the schedule.
    gathered = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys(fields)))).alias("todo"))
    joined = gathered.join(state.select(key, *slots), key)
    done_type = "array<struct<id:string,accepted:boolean,reason:string,blocked_by:string>>"
    start = F.struct(
        *[F.col(s).cast(t).alias(s) for s, t in slots.items()],
        *[F.lit(None).cast("string").alias(f"by_{s}") for s in slots],
        F.array().cast(done_type).alias("done"),
    )

    def step(acc: Column, a: Column) -> Column:
        # The candidate state is the action's value in its slot.
        after = {s: F.when(a["slot"] == s, a[f"to_{s}"]).otherwise(acc[s]) for s in slots}
        blocker = F.coalesce(*[F.when(a["slot"] == s, acc[f"by_{s}"]) for s in slots])
        shadowed = blocker.isNotNull() if conflict else F.lit(False)
        reason = (
            F.when(a["refused"].isNotNull(), a["refused"])
            .when(shadowed, F.lit("shadowed_by_prior_accepted_action"))
            .when(F.coalesce(admissible(after), F.lit(False)), F.lit("admissible"))
            .otherwise(F.lit("inadmissible"))
        )
        taken = reason == "admissible"
        decided = F.struct(a["id"].alias("id"), taken.alias("accepted"), reason.alias("reason"), F.when(reason.startswith("shadowed"), blocker).alias("blocked_by"))
        return F.struct(
            *[F.when(taken, after[s]).otherwise(acc[s]).cast(t).alias(s) for s, t in slots.items()],
            *[F.when(taken & (a["slot"] == s) & acc[f"by_{s}"].isNull(), a["id"]).otherwise(acc[f"by_{s}"]).alias(f"by_{s}") for s in slots],
            F.array_append(acc["done"], decided).alias("done"),
        )

    folded = joined.select(key, F.aggregate("todo", start, step).alias("end"))
    return folded.select(key, *[F.col(f"end.{s}").alias(s) for s in slots], F.col("end.done").alias("decisions"))


def decisions(folded: DataFrame, key: str) -> DataFrame:
    return folded.select(key, F.posexplode("decisions").alias("place", "d")).select(key, "place", "d.id", "d.accepted", "d.reason", "d.blocked_by")


def fold_budget(requests: DataFrame, key: str, order: list[str], amount: str, budget: str) -> DataFrame:
    """Greedy admission against a budget per component: ``key``, ``id``, ``amount``, ``accepted``.

    ``requests`` has ``key``, ``id``, ``order`` and the two amounts (whole numbers).
    """
    gathered = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "id", amount))).alias("todo"), F.max(budget).alias("budget"))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<struct<id:string,amount:bigint,accepted:boolean>>").alias("done"))

    def step_for(limit: Column):
        def step(acc: Column, a: Column) -> Column:
            fits = acc["total"] + a[amount] <= limit
            return F.struct(
                (acc["total"] + F.when(fits, a[amount]).otherwise(0)).cast("bigint").alias("total"),
                F.array_append(acc["done"], F.struct(a["id"].cast("string").alias("id"), a[amount].cast("bigint").alias("amount"), fits.alias("accepted"))).alias("done"),
            )

        return step

    folded = gathered.select(key, F.aggregate("todo", start, step_for(F.col("budget"))).alias("end"))
    return folded.select(key, F.explode("end.done").alias("d")).select(key, "d.id", "d.amount", "d.accepted")
