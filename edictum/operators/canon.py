"""Canonical lines, digests and differences of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edictum.sources.terms import n3_line


def lines(state: DataFrame) -> DataFrame:
    return state.select(n3_line(F.col("s"), F.col("p"), F.col("o")).alias("line")).distinct()


def digest_column(line: str = "line"):
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)


def digest(state: DataFrame) -> str:
    """SHA-256 over the sorted canonical lines (one value, so one task sorts them)."""
    return lines(state).agg(digest_column()).first()[0]


def snapshot(state: DataFrame) -> DataFrame:
    """triples (sorted lines), digest, triple_count: one row."""
    return lines(state).agg(F.array_sort(F.collect_list("line")).alias("triples"), digest_column().alias("digest"), F.count("*").alias("triple_count"))


def delta(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines removed and lines inserted."""
    a, b = lines(before), lines(after)
    return a.subtract(b), b.subtract(a)


def apply_writes(state: DataFrame, writes: DataFrame) -> DataFrame:
    """``state`` with the slots (s, p) of ``writes`` (s, p, o) replaced."""
    return state.join(writes.select("s", "p").distinct(), ["s", "p"], "left_anti").select("s", "p", "o").unionByName(writes.select("s", "p", "o"))


def _versions(state: DataFrame, accepted: DataFrame) -> DataFrame:
    """s, p, i, until, held: the lines of each slot from one accepted write (or -1) to the next."""
    slots = accepted.select("s", "p").distinct()
    start = state.join(slots, ["s", "p"], "left_semi").select(F.lit(-1).alias("i"), "s", "p", "o")
    versions = start.unionByName(accepted.select("i", "s", "p", "o")).withColumn("line", n3_line(F.col("s"), F.col("p"), F.col("o")))
    until = F.lead("i").over(Window.partitionBy("s", "p").orderBy("i"))
    return versions.groupBy("s", "p", "i").agg(F.collect_set("line").alias("held")).withColumn("until", until)


def subject_digests_along(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """schedule_index, pre_graph_digest, post_graph_digest of the triples of each decision's subject.

    The digest of one component instead of the whole state: work for a decision is in proportion to
    its subject, so this holds for states of any size.
    """
    accepted = decisions.where("accepted").select(F.col("schedule_index").alias("i"), "s", "p", "o")
    subject = F.regexp_extract("target_key", r"^(.*)\|[^|]*$", 1)
    asked = decisions.select(F.col("schedule_index").alias("at"), subject.alias("s"))
    asked = asked.select("s", "at", F.explode(F.array(F.struct(F.lit("pre").alias("kind"), (F.col("at") - 1).alias("t")), F.struct(F.lit("post").alias("kind"), F.col("at").alias("t")))).alias("x")).select("s", "at", "x.*")
    slots = accepted.select("s", "p").distinct()
    fixed = state.join(slots, ["s", "p"], "left_anti").join(asked.select("s").distinct(), "s", "left_semi")
    never = F.lit(None).cast("int").alias("until")
    whole = fixed.select("s", "p", F.lit(-1).alias("i"), F.array(n3_line(F.col("s"), F.col("p"), F.col("o"))).alias("held"), never)
    lived = whole.unionByName(_versions(state, accepted)).withColumnRenamed("s", "_s")
    held = asked.join(lived, (F.col("s") == F.col("_s")) & (F.col("i") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    lines = held.select("at", "kind", F.explode("held").alias("line")).distinct()
    found = lines.groupBy("at", "kind").agg(digest_column().alias("digest"))
    return found.groupBy(F.col("at").alias("schedule_index")).agg(*[F.max(F.when(F.col("kind") == k, F.col("digest"))).alias(f"{k}_graph_digest") for k in ("pre", "post")])


def digests_along(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """schedule_index, pre_, candidate_ and post_graph_digest of every decision.

    For each decision the state after it is put together from the slots not yet written and
    the last accepted write of each slot so far; all decisions are digested in parallel.  The
    candidate is what the constraints looked at: null where an earlier gate refused.  Each
    digest is over the whole state, so this is for small ones (``subject_digests_along``).
    """
    accepted = decisions.where("accepted").select(F.col("schedule_index").alias("i"), "s", "p", "o")
    slots = accepted.select("s", "p").distinct()
    first = _versions(state, accepted)
    fixed = state.join(slots, ["s", "p"], "left_anti").select(n3_line(F.col("s"), F.col("p"), F.col("o")).alias("line")).distinct()
    # The states after and before each decision; of the recorded ones some may be left out.
    steps = decisions.select(F.explode(F.array("schedule_index", F.col("schedule_index") - 1)).alias("at")).distinct()
    live = steps.join(first, (F.col("i") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))).select("at", F.explode("held").alias("line"))
    every = live.union(steps.crossJoin(fixed))
    found = every.groupBy("at").agg(digest_column().alias("post"))
    before = found.select((F.col("at") + 1).alias("schedule_index"), F.col("post").alias("pre_graph_digest"))
    both = before.join(found.select(F.col("at").alias("schedule_index"), F.col("post").alias("post_graph_digest")), "schedule_index")
    # The candidate of an inadmissible action: the state before it with its own write.
    tried = decisions.where("reason = 'inadmissible'").select(F.col("schedule_index").alias("at"), F.col("s").alias("_s"), F.col("p").alias("_p"), n3_line(F.col("s"), F.col("p"), F.col("o")).alias("own"))
    slot = F.concat(F.lit("<"), F.col("_s"), F.lit("> <"), F.col("_p"), F.lit("> "))
    left = every.join(tried, "at").where(~F.col("line").startswith(slot)).select("at", "line")
    refused = left.union(tried.select("at", F.col("own").alias("line"))).groupBy("at").agg(digest_column().alias("refused"))
    looked = decisions.select("schedule_index", "accepted").join(refused.withColumnRenamed("at", "schedule_index"), "schedule_index", "left")
    candidate = F.when(F.col("accepted"), F.col("post_graph_digest")).otherwise(F.col("refused")).alias("candidate_graph_digest")
    return both.join(looked, "schedule_index").select("schedule_index", "pre_graph_digest", candidate, "post_graph_digest")
