"""Op 5: proportional stratified interleaving of documents into shards.

Every source's rows are put in a seeded pseudo-random order; the row of rank r among n
gets the fraction (2r-1)/2n; all rows are sorted by that fraction and the sequence is cut
into equal runs.  Every run then holds each source in its overall proportion, to within
one row per source, and the runs' row counts differ by one at most (law ``rows``).

Ranks are found without a global sort: a seeded 64-bit hash orders a source, its leading
bits name a bucket, ranks are counted inside (source, bucket) and the buckets' offsets
come from an aggregate.  A source with any share of the rows is thus dealt over all
buckets.  The second order, by fraction, needs no second count of rows: which fractions the
ranks of a cell (source, bucket) have follows from their numbers alone.

Law ``rows`` deals every row by itself: documents of equal texts are not kept together; those of
one source are spread like its other rows.

Defined cases: a null text has size 16 and CRC 0; null sources are one source; very long texts
count as one row; ties of the seeded key are ordered by doc_id, CRC and size; an empty table gives
no rows; repeated rows each get a place; a null doc_id is kept; columns of the input other
than those named are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictum.llm.common import bucket_bits, saved, top_bits

OVERHEAD = 16


def interleaved(docs: DataFrame, seed: int = 7, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``docs`` with ``_place``, its 0-based place in the interleaved order; the row count.

    Looks at doc_id, source and text; keeps doc_id, ``_size``, ``_crc`` and ``carry``.
    """
    raw = F.encode("text", "UTF-8")
    # Written once without the texts: ranks and counts must be of the same rows.
    rows = saved(
        docs.select(
            *[F.col(c) for c in dict.fromkeys(("doc_id", *carry))],
            F.col("source").alias("_source"),
            (F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + OVERHEAD).alias("_size"),
            F.coalesce(F.crc32(raw), F.lit(0)).alias("_crc"),
            F.xxhash64(F.lit(seed), "doc_id", "source").alias("_key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    bits = bucket_bits(total)
    buckets = 1 << bits
    rows = rows.withColumn("_bucket", top_bits(F.col("_key"), bits))
    per_bucket = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("_source").alias("_s"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy("_source")).alias("_of"),
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "_crc", "_size")
    ranked = (
        rows.withColumn("_in", F.row_number().over(inside))
        .join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_rank", F.col("_offset") + F.col("_in"))
        .withColumn("_band", F.expr(f"((2 * _rank - 1) * {buckets}L) div (2 * _of)").cast("int"))
    )
    # Of a source's n ranks those with (2r-1) * buckets < 2n * band are in the bands before.
    # A cell (source, bucket) holds ranks in a row, so only the bands that it meets are listed.
    cells = offsets.join(per_bucket, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_bucket"))).select("_of", "_offset", (F.col("_offset") + F.col("_n")).alias("_end"))
    first, last = (F.expr(f"((2 * {r} - 1) * {buckets}L) div (2 * _of)") for r in ("(_offset + 1)", "_end"))

    def ranks_before(band: str) -> Column:
        return F.when(F.col(band) <= 0, 0).otherwise(F.expr(f"((2 * _of * {band} - 1) div {buckets}L + 1) div 2"))

    met = cells.withColumn("_g", F.explode(F.sequence(first, last))).withColumn("_h", F.col("_g") + 1)
    met = met.withColumn("_held", F.least("_end", ranks_before("_h")) - F.greatest("_offset", ranks_before("_g")))
    sizes = met.groupBy(F.col("_g").cast("int").alias("_g")).agg(F.sum("_held").alias("_held"))
    # One row a band: as many as there are buckets.
    bands = sizes.select("_g", F.coalesce(F.sum("_held").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    band = Window.partitionBy("_band").orderBy((2 * F.col("_rank") - 1) / (2 * F.col("_of")), "_source", "_rank")
    placed = ranked.withColumn("_at", F.row_number().over(band)).join(bands, F.col("_band") == F.col("_g"))
    return placed.withColumn("_place", F.col("_before") + F.col("_at") - 1), total


def cut(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """``placed`` with shard and slot: runs of floor or ceil of total/shards rows."""
    shard = F.expr(f"_place * {shards}L div {max(total, 1)}L")
    start = F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("_shard", shard).withColumn("_slot", F.col("_place") - start)


def sharded_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` with size, text_crc32, law, shard and slot.

    Places are found for narrow rows; texts are shuffled once, to meet them.  Rows that are
    equal in all columns are one text there, joined with all its places.  Columns of ``docs`` that
    are named like the result's are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot"]
    names = [c for c in docs.columns if c not in made]
    identity = F.md5(F.to_json(F.struct(*[docs[c] for c in names]), {"ignoreNullFields": "false"})).alias("_row")
    places = saved(shard_rows(docs.select("doc_id", "source", "text", identity), shards, seed, ("_row",)).select(*made, F.col("_row").alias("_at")), "places")
    held = docs.select(identity, *[docs[c].alias(f"_d{i}") for i, c in enumerate(names)]).dropDuplicates(["_row"])
    return places.join(held, F.col("_at") == F.col("_row")).select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)], *made)


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed, total = interleaved(docs, seed, carry)
    return cut(placed, total, shards).select(
        *[F.col(c) for c in dict.fromkeys(("doc_id", *carry))],
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
