"""Op 10: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets.  Sources in code-point order (null last) get the cycling weights; a common
   level is found such that min(cap x size, level x weight) sums to the wanted total.
2. Passes.  A source's documents are put in a seeded order.  The mix takes whole passes
   over it and, for the rest, the prefix of the order whose words come nearest the target,
   so a document is taken as often as the passes that reach it, at most ``cap`` times.
3. Splitting tree.  Each source's stream is cut into blocks of nearly equal words, by its
   exact quota.  At every node of a binary tree over the output shards the node's blocks
   are drawn without replacement into two halves, so that the sources' counts in a half
   follow the multivariate hypergeometric law; leaves are shards.  The tree works on block
   numbers alone: shards x blocks_per_shard of them, however large the data are.
4. A document goes where its block goes; rows are shuffled inside a shard by a seeded key
   (``mixed_documents`` writes them in that order).

Sums along a source's order come from sums per (source, bucket of the order) and from a
running sum inside a bucket, so a source with any share of the rows is spread evenly.

Defined cases: a null text has size 0; null sources are one source, the last; documents
of size 0 are taken 0 words; very long texts are taken or left whole; a null doc_id is a value like
others; ties of the seeded order are rows of one doc_id, source and text; an empty table gives no
rows; repeated rows count each; columns other than doc_id, source and text are only carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictum.llm.common import WORD, bucket_bits, running, saved, top_bits

WEIGHTS = (3, 1, 2)


def order_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size in words and the key of the seeded order; written once."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return saved(
        docs.select("doc_id", "source", size.alias("size"), order_key(seed).alias("_key")),
        "mix-sizes",
    )


def targets(sizes: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, sid, source_size, target: one row per source, weights dealt by code point."""
    named = running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()])
    found = (
        named.withColumn("sid", (F.col("_before") + 1).cast("int"))
        .drop("_before")
        .withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * cap)
    )
    # In order of cap/weight: once the sources before are at their caps, the level left.
    ratio = (F.col("_cap") / F.col("_w")).alias("_ratio")
    ordered = running(found, [F.col("_cap") / F.col("_w"), F.col("sid")], ("_cap", "_w"))
    whole = found.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_weights"))
    # The one row of sums is joined to every source by a key, as any small table.
    level = (F.col("_all") * share - F.col("__cap_before")) / (F.col("_weights") - F.col("__w_before"))
    tried = ordered.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one").withColumn("_level", level).select("sid", ratio, "_level")
    chosen = tried.where("_level <= _ratio").agg(F.min(F.struct("_ratio", "sid", "_level"))["_level"].alias("_chosen")).withColumn("_one", F.lit(1))
    goal = F.least(F.col("_cap").cast("double"), F.coalesce("_chosen", F.lit(float("inf"))) * F.col("_w"))
    return found.withColumn("_one", F.lit(1)).join(F.broadcast(chosen), "_one").select("source", "sid", "source_size", goal.alias("target"))


def split_tree(goals: DataFrame, shards: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """sid, block, shard: every source's blocks dealt to shards level by level.

    ``shards`` is a power of two.  A node passes half of its blocks, drawn without
    replacement, to either child.
    """
    levels = shards.bit_length() - 1
    assert shards == 1 << levels, "shards must be a power of two"
    total = goals.agg(F.sum("target").alias("_total")).withColumn("_one", F.lit(1))
    quota = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") * (shards * blocks_per_shard) / F.col("_total")).cast("int"))).otherwise(0)
    blocks = (
        goals.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .withColumn("quota", quota)
        .where("quota > 0")
        .select("sid", "quota", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("block"))
        .withColumn("shard", F.lit(0))
    )
    for level in range(levels):
        node = Window.partitionBy("shard")
        drawn = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "sid", "block"), "sid", "block"))
        right = (drawn > F.ceil(F.count("*").over(node) / 2)).cast("int")
        blocks = blocks.withColumn("_right", right).select("sid", "quota", "block", (F.col("shard") * 2 + F.col("_right")).alias("shard"))
    return blocks


def mix(docs: DataFrame, shards: int = 16, blocks_per_shard: int = 64, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, and the
    shard and shuffle key of its first and second copy (null where not taken)."""
    sizes = sized(docs, seed)
    bits = bucket_bits(sizes.count())
    goals = saved(targets(sizes, share, cap, weights), "mix-targets")
    bucket = top_bits(F.col("_key"), bits)
    sums = sizes.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), "_b", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    offsets = offsets.join(goals.withColumnRenamed("source", "_name"), F.col("_s").eqNullSafe(F.col("_name")))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sizes.withColumn("_bucket", bucket)
        .withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_from", F.col("_offset") + F.col("_in"))
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("_passes") + (F.col("_from") + F.col("size") / 2 < F.col("_rest")).cast("int")).otherwise(0).cast("int"))
    )
    dealt = saved(split_tree(goals, shards, blocks_per_shard, seed), "mix-blocks")
    quotas = dealt.select(F.col("sid").alias("_q"), F.col("quota").alias("_quota")).distinct()
    rows = rows.join(quotas, F.col("sid") == F.col("_q"), "left")

    def block(copy: int) -> Column:
        middle = F.col("_from") + F.col("size") / 2 + copy * F.col("source_size")
        return F.least(F.col("_quota") - 1, F.floor(middle * F.col("_quota") / F.col("target"))).cast("int")

    for copy, name in ((0, "first"), (1, "second")):
        mine = dealt.select(F.col("sid").alias("_sid"), F.col("block").alias("_block"), F.col("shard").alias(f"{name}_shard"))
        at = F.when(F.col("copies") > copy, block(copy))
        rows = rows.withColumn(f"{name}_block", at).join(mine, (F.col("sid") == F.col("_sid")) & (F.col(f"{name}_block") == F.col("_block")), "left").drop("_sid", "_block")
        rows = rows.withColumn(f"{name}_key", F.when(F.col("copies") > copy, F.xxhash64(F.lit(seed), F.lit(copy), "doc_id", "source")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
        "first_block", "first_shard", "first_key", "second_block", "second_shard", "second_key",
        F.col("source").alias("mix_source"), F.col("_passes").cast("int").alias("passes"), F.col("_key").alias("order_key"),
    )


def mixed_documents(docs: DataFrame, seed: int = 11, slices: int = 16, shard_column: str | None = None, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``,
    shard by shard of the splitting tree and shuffled inside each.

    What a source gives beyond whole passes is a prefix of its seeded order, and so is each of its
    blocks a stretch of it: keys of blocks (some thousand, however large the data are) tell a row's
    copies and their shards.  Texts are shuffled once, to their shards; a shard is ``slices``
    partitions, cut and ordered by the seeded key of the copies.  ``shard_column`` adds the shard.
    """
    taken = mix(docs, seed=seed, **settings)

    def place(key: Column) -> Column:
        return key.bitwiseXOR(F.lit(-(1 << 63)))  # buckets order keys as unsigned numbers

    last = F.max(F.when(F.col("copies") > F.col("passes"), place(F.col("order_key"))))
    ends = saved(taken.groupBy("mix_source").agg(F.max("passes").alias("_passes"), last.alias("_last")), "mix-ends")
    # Of each pass the last key of each stretch that goes to one shard, in order.
    placed = taken.select("mix_source", place(F.col("order_key")).alias("_key"), F.explode(F.array(*[F.struct(F.lit(i).alias("copy"), F.col(f"{name}_block").alias("block"), F.col(f"{name}_shard").alias("shard")) for i, name in enumerate(("first", "second"))])).alias("c"))
    stretches = placed.where("c.shard IS NOT NULL").groupBy("mix_source", "c.copy", "c.block", "c.shard").agg(F.max("_key").alias("until"))
    by_source = stretches.groupBy(F.col("mix_source").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("copy", "until", "shard"))).alias("_stretches"))
    ends = saved(ends.join(by_source, F.col("mix_source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-stretches")
    copies = F.col("_passes") + F.coalesce((F.col("_key") <= F.col("_last")).cast("int"), F.lit(0))
    mine = F.filter("_stretches", lambda x: (x["copy"] == F.col("_copy")) & (F.col("_key") <= x["until"]))
    names = [f"_d{i}" for i in range(len(docs.columns))]  # columns of any name, ours among them
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], docs["source"].alias("_s"), place(order_key(seed)).alias("_key"), F.regexp_count(docs["text"], F.lit(WORD)).alias("_words"))
    rows = (
        rows.where("_words > 0")
        .join(ends, F.col("_s").eqNullSafe(F.col("mix_source")))
        .withColumn("_copies", copies)
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .withColumn("_shard", F.get(mine, F.lit(0))["shard"])
        .withColumn("_order", F.xxhash64(F.lit(seed), "_copy", "_key"))
        .withColumn("_slice", F.pmod(F.shiftright("_order", 40), F.lit(slices)))
    )
    dealt = rows.repartition("_shard", "_slice").sortWithinPartitions("_shard", "_slice", "_order")
    shard = [F.col("_shard").alias(shard_column)] if shard_column else []
    return dealt.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], *shard)
