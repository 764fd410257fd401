"""Places in one global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictum.sources.shared import written


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, their 0-based place in ``order``.

    Range partitions are numbered apart, and moved on by the rows of the partitions before
    them.  They are written once: their bounds must not be drawn twice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    found = dealt.withColumn("_inside", inside).join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return found.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("int")).drop("_part", "_p", "_offset", "_inside")
