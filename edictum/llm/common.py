"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the controls 9 to 13.
#: In Python, ``bytes.split()`` without arguments cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a
    cluster no folder of the driver's would do, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="edictum-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[list[str]] = []
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage: a lost executor costs only the reading tasks.  Tables lie in one folder
    for each application; inside ``scratch`` they are deleted at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    _places[found] = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def done_with(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing will read again, before their block ends; other frames are left."""
    for found in tables:
        if found in _places:
            _delete(found.sparkSession, _places.pop(found))


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that are saved inside the block, when it ends.

    What is to outlast the block has to be written elsewhere (``kept_after``).
    """
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            _delete(spark, path)


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Shuffle files of what is written inside the block go as each table is done; else they stay
    until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES, None)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES)
        else:
            spark.conf.set(SHUFFLES, before)


def kept_after(df: DataFrame, name: str) -> DataFrame:
    """``saved``, but not deleted at the end of the scratch block around it."""
    made = _made.pop() if _made else None
    try:
        return saved(df, name)
    finally:
        if made is not None:
            _made.append(made)


def handed_on(found: DataFrame) -> DataFrame:
    """A table of ``saved`` that outlasts the scratch block it was made in, not the one around that."""
    _made[-1].remove(_places[found])
    if len(_made) > 1:
        _made[-2].append(_places[found])
    return found


def slices(batches, rows: int = 256):
    """Arrow batches in slices, so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def top_bits(hashed: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash: an evenly filled bucket number."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int") if bits else F.lit(0)


def bucket_bits(rows: int, per_bucket: int = 200_000, least: int = 8) -> int:
    """Bits of bucket number so that a bucket holds ``per_bucket`` rows at most."""
    return max(least, (max(1, rows) // per_bucket).bit_length())


def running(rows: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` in one global order: ``_before``, the rows before each, and ``_<name>_before``
    for the columns to sum.

    Range partitions are counted apart and joined with what the partitions before them hold, so
    no task sees all rows.  The partitions are written: their bounds must not be drawn twice.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    totals = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_n_{s}") for s in sums])
    offsets = totals.select("_p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_o{c}") for c in ["_n", *[f"_n_{s}" for s in sums]]])
    found = dealt.withColumns({"_before": F.count("*").over(inside), **{f"_{s}_before": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}})
    found = found.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    found = found.withColumns({"_before": F.col("_before") + F.col("_o_n"), **{f"_{s}_before": F.col(f"_{s}_before") + F.col(f"_o_n_{s}") for s in sums}})
    return found.drop("_part", "_p", *[f"_o{c}" for c in ["_n", *[f"_n_{s}" for s in sums]]])


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
