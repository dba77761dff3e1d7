"""Pieces shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word, as every contract of this package counts it: ASCII white space separates, nothing else does.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    """The number of words of a text."""
    return F.size(words(text)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one (tests) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local["):
            folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows with lineage cut by a reliable checkpoint, so lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver notice now which shuffles and checkpoints nothing refers to any more, so that their files go.

    Long jobs call this after a checkpoint; else those files stay until the driver happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str, sums: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same group, exclusive.

    ``bucket`` is a column that ascends with ``order`` and cuts every group into pieces that fit a task, so a group
    that holds a third of all rows is still spread out. Bucket sums are pre-aggregated before they are shuffled, and
    only one row for each (group, bucket) passes through the window that turns them into offsets.
    Columns in ``group`` and ``bucket`` must not be null. ``sums`` may give the bucket sums: ``group, bucket, _sum``.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum")) if sums is None else sums
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(offsets, keys)
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_offset")


#: A key that holds one in so many of all rows is hot; there can be no more hot keys than that.
HOT = 1_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """An inner equi-join of ``rows`` with a checkpointed ``table`` that has one row for each key, in which hot keys are dealt over all tasks.

    ``weight`` is a column of the table: how many of the rows have the key. Hot keys, HOT at most whatever the size of the data, are broadcast;
    their rows are salted by what they hold, and the table's are repeated for every salt. The weight is left out of the result.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = table.where(F.col(weight) * HOT >= whole).select(*keys, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(parts))).otherwise(0)
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = table.drop(weight).join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def small_batches(spark: SparkSession, rows: int = 512, size: str = "4m") -> None:
    """Keep Arrow batches small: texts and arrays may be very long, and a batch is held whole on both sides.

    These are settings of the session, as Spark has none for a single plan; they are only ever lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(rows if now <= 0 else min(now, rows)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
