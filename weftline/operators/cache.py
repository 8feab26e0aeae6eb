"""Cache lookup, freshness, upsert and pruning over a table (key, url, body, content_type, ts_ms, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.urls import cache_key

TTL_MS, STALE_MS, ENTRIES, BYTES = 3_600_000, 86_400_000, 128, 128 << 20
# The lines below a text that the cache gave.
SERVED = "\n\n*Served from cache — network fetch failed*"
STALE = ("\n\n*STALE cache from ", " — network fetch failed, serving cached copy*")


def is_fresh(ts_ms: Column, now_ms: int) -> Column:
    return F.lit(now_ms) - ts_ms < TTL_MS


def stale_notice(ts_ms: Column) -> Column:
    """The line below a text that an old entry gave, with the entry's day in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / 86_400_000).cast("int"))
    return F.concat(F.lit(STALE[0]), day.cast("string"), F.lit(STALE[1]))


def notice(ts_ms: Column, now_ms: int) -> Column:
    return F.when(is_fresh(ts_ms, now_ms), F.lit(SERVED)).otherwise(stale_notice(ts_ms))


def prune(cache: DataFrame, now_ms: int, entries: int = ENTRIES, size: int = BYTES) -> DataFrame:
    """The newest entries, younger than the stale limit, within both caps. Only rows that can survive the count are ranked: a top-k first keeps the one-partition window small."""
    alive = cache.where(F.lit(now_ms) - F.col("ts_ms") < STALE_MS).orderBy(F.desc("ts_ms"), "key").limit(entries)
    run = F.sum("size").over(Window.orderBy(F.desc("ts_ms"), "key").rowsBetween(Window.unboundedPreceding, 0))
    return alive.withColumn("total", run).where(F.col("total") <= size).drop("total")


def totals(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def leftover_files(files: DataFrame, now_ms: int) -> DataFrame:
    """Of ``files`` (path, modificationTime) the unfinished ones that are an hour old."""
    age = F.lit(now_ms) - F.unix_millis("modificationTime")
    return files.where(F.contains(F.substring_index("path", "/", -1), F.lit(".tmp.")) & (age >= TTL_MS))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    newest = Window.partitionBy("key").orderBy(F.desc("ts_ms"))
    return cache.unionByName(new).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def lookup(urls: DataFrame, cache: DataFrame, now_ms: int) -> DataFrame:
    """``urls`` (url, ...) with the entry of their key: body, content_type, ts_ms, ``fresh``. Entries that lack a part count as none; old ones go when the cache is pruned, not here."""
    whole = cache.where(F.col("body").isNotNull() & F.col("content_type").isNotNull() & F.col("ts_ms").isNotNull())
    entry = whole.select(F.col("key").alias("_key"), F.col("body").alias("cached_body"), F.col("content_type").alias("cached_type"), F.col("ts_ms").alias("cached_ms"))
    found = urls.withColumn("_key", cache_key(F.col("url"))).join(entry, "_key", "left").drop("_key")
    return found.withColumn("fresh", is_fresh(F.col("cached_ms"), now_ms))
