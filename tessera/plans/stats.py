"""Statistics that are put together from parts: collection statistics over shards and their distribution."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions.expressions import data_format

SUMMED = ("count", "size", "storageSize", "totalIndexSize", "totalSize", "numOrphanDocs")
SCALED = ("size", "storageSize", "totalIndexSize", "totalSize")


def combined_stats(shards: DataFrame, scale: float = 1) -> DataFrame:
    """One row of statistics over a table with a row for each shard.

    Sums of counts and sizes, the largest ``maxSize`` and ``nindexes``, ``capped`` of the first shard, the average object size weighed
    by counts (0 without objects), and ``indexSizes`` (a map) summed by index; sizes are divided by ``scale``.
    """
    has = set(shards.columns)
    number = lambda c: F.col(c).cast("double")
    aggregates = [F.sum(number(c)).alias(c) for c in SUMMED if c in has]
    if "avgObjSize" in has:
        total = F.sum(F.coalesce(number("count"), F.lit(0.0)))
        weighed = F.sum(number("avgObjSize") * F.coalesce(number("count"), F.lit(0.0)))
        aggregates.append(F.when(total > 0, weighed / total).otherwise(0.0).alias("avgObjSize"))
    aggregates += [F.max(number(c)).alias(c) for c in ("maxSize", "nindexes") if c in has]
    if "capped" in has:
        aggregates.append(F.first("capped", ignorenulls=True).alias("capped"))
    out = shards.agg(*aggregates)
    out = out.withColumns({c: F.col(c) / scale for c in (*SCALED, "maxSize") if c in out.columns})
    if "indexSizes" in has:
        entries = shards.select(F.explode("indexSizes").alias("k", "v")).groupBy("k").agg((F.sum(F.col("v").cast("double")) / scale).alias("v"))
        held = entries.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("indexSizes"))
        out = out.crossJoin(held)  # one row each
    return out


def scaled_shards(shards: DataFrame, scale: float = 1) -> DataFrame:
    """Every shard's row with its sizes, and those of its indexes, divided by ``scale``."""
    out = shards.withColumns({c: F.col(c) / scale for c in (*SCALED, "maxSize") if c in shards.columns})
    if isinstance(shards.schema["indexSizes"].dataType if "indexSizes" in shards.columns else None, T.MapType):
        out = out.withColumn("indexSizes", F.transform_values("indexSizes", lambda k, v: v / scale))
    return out.withColumn("scaleFactor", F.lit(scale)) if "scaleFactor" in shards.columns else out


def shard_distribution(shards: DataFrame) -> DataFrame:
    """Rows ``(shard, data, docs, chunks, data_per_chunk, docs_per_chunk, data_percent, docs_percent, avg_size)``.

    ``shards`` has ``shard, size, count, numChunks, avgObjSize`` and perhaps ``numOrphanDocs``, whose share is taken off the
    size; percentages are cut to two places. There is a row for each shard, so the totals are a small aggregate.
    """
    orphans = F.coalesce(F.col("numOrphanDocs"), F.lit(0)) if "numOrphanDocs" in shards.columns else F.lit(0)
    rows = shards.withColumn("_size", F.col("size") - orphans * F.coalesce(F.col("avgObjSize"), F.lit(0)))
    totals = rows.agg(F.sum("_size").alias("_all_size"), F.sum("count").alias("_all_count"))
    rows = rows.crossJoin(F.broadcast(totals))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.floor(F.col(a) / F.col(b) * 10000) / 100)
    chunks = F.col("numChunks")
    return rows.select(
        "shard",
        data_format(F.col("_size")).alias("data"),
        F.col("count").alias("docs"),
        chunks.alias("chunks"),
        data_format(F.when(chunks == 0, 0).otherwise(F.try_divide("_size", chunks))).alias("data_per_chunk"),
        F.when(chunks == 0, 0).otherwise(F.floor(F.try_divide("count", chunks))).alias("docs_per_chunk"),
        share("_size", "_all_size").alias("data_percent"),
        share("count", "_all_count").alias("docs_percent"),
        data_format(F.col("avgObjSize")).alias("avg_size"),
    )


def share_of_total(df: DataFrame, column: str, out: str = "share") -> DataFrame:
    """Add the percentage of a column's total, cut to two places; the total is an aggregate of one row, no window over everything."""
    total = df.agg(F.sum(column).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.floor(F.col(column) / F.col("_total") * 10000) / 100).drop("_total")


def first_last_difference(df: DataFrame, at: str) -> DataFrame:
    """One row ``(first, last, seconds, hours)`` of a column of times; hours are rounded to two places."""
    ends = df.agg(F.min(at).alias("first"), F.max(at).alias("last"))
    seconds = F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    return ends.withColumn("seconds", seconds).withColumn("hours", F.round(F.col("seconds") / 36) / 100)


def first_n_per_group(df: DataFrame, group: str, order: list[str], n: int = 20) -> DataFrame:
    """The first rows of each group, and ``truncated``: how many more it has. Spark limits groups before it shuffles them."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    kept = df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    counts = df.groupBy(F.col(group).alias("_group")).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("truncated"))
    return kept.join(counts, kept[group].eqNullSafe(counts["_group"])).drop("_group")


def key_frequencies(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows ``(key, n)``: a key's values as documents and how many rows have them."""
    return df.groupBy(*(F.col(f"`{c}`") for c in key)).agg(F.count(F.lit(1)).alias("n")).select(F.struct(*(F.col(f"`{c}`") for c in key)).alias("key"), "n")


def database_collections(databases: DataFrame, collections: DataFrame, name: str = "_id", ns: str = "_id") -> DataFrame:
    """Every database with its collections, whose names begin with the database's and a point: an equi-join on what stands before the first point."""
    parts = collections.select(F.substring_index(ns, ".", 1).alias("_db"), F.col(ns).alias("collection"))
    return databases.join(parts, databases[name] == parts["_db"], "left").drop("_db")


def collection_chunks(collections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``collections`` (``_id, uuid``) with ``chunks``, the number of theirs by shard: chunks name their collection by uuid or, older ones, by ``ns``.

    One equi-join for all collections instead of a query for each.
    """
    counted = chunks.groupBy(F.coalesce("uuid", "ns").alias("_key"), "shard").agg(F.count(F.lit(1)).alias("chunks"))
    by_uuid = collections.join(counted, collections["uuid"] == counted["_key"])
    by_name = collections.join(counted, collections["_id"] == counted["_key"])
    return by_uuid.unionByName(by_name).select(collections["_id"], "shard", "chunks")


def collection_stats(store: Any, db: str, name: str, scale: float = 1) -> dict:
    """Count and sizes of one collection from its files; the count comes from the Parquet footers."""
    size, files = store.size(db, name)
    count = store.read(db, name).count()
    indexes = store.indexes.get((db, name), [])
    return {
        "ns": f"{db}.{name}", "count": count, "size": size / scale, "storageSize": size / scale, "avgObjSize": size / count if count else 0,
        "totalIndexSize": 0, "totalSize": size / scale, "nindexes": len(indexes) + 1, "indexSizes": dict.fromkeys(["_id_", *(i["name"] for i in indexes)], 0),
        "numFiles": files, "capped": bool(store.options.get((db, name), {}).get("capped")), "sharded": False, "scaleFactor": scale, "ok": 1,
    }
