"""Weighted reciprocal-rank fusion, domain caps and top-k, as one declarative plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import collapse_whitespace
from weftline.functions.urls import canonicalize, registrable_domain

K = 60
RESULTS, MOST_RESULTS = 5, 20
# The sentence below the results, and what stands for none.
CLOSING = "These are only short snippets. To read a page, call web_fetch with its URL."
NO_RESULTS, NONE_ALLOWED = "No results found.", "No results found within the website access limits."


def clamp_results(n: float | None) -> int:
    """A number of results from 1 to 20; 5 for none."""
    return RESULTS if n is None or n != n else min(MOST_RESULTS, max(1, int(n // 1) if abs(n) < 1e9 else MOST_RESULTS if n > 0 else 1))


def positive(n) -> int | None:
    """A positive whole number from a number, else None."""
    return int(n // 1) if isinstance(n, (int, float)) and not isinstance(n, bool) and abs(n) < float("inf") and n // 1 > 0 else None


def candidates(hits: DataFrame) -> DataFrame:
    """``hits`` (query, engine, ord, rank, title, href, body) with ``canon``; blank hrefs go."""
    return hits.where(F.trim("href") != "").withColumn("canon", canonicalize(F.col("href"))).where("canon <> ''")


def scores(cand: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(query, canon, score): of an engine only its first occurrence counts; engines without a weight have 1. A ``vector`` column in ``weights`` gives one score a vector."""
    first = cand.groupBy("query", "engine", "canon").agg(F.min("rank").alias("rank"))
    keys = ["query", "canon"]
    if weights is None:
        part = first.withColumn("w", F.lit(1.0))
    else:
        part = first.join(weights, "engine", "left")
        keys += ["vector"] if "vector" in weights.columns else []
    return part.groupBy(*keys).agg(F.round(F.sum(F.coalesce("w", F.lit(1.0)) / (K + F.col("rank"))), 12).alias("score"))


def best_documents(cand: DataFrame) -> DataFrame:
    """Of all hits on a page the one with the longest body, ties to the earliest arrival; its href is the canonical one."""
    order = Window.partitionBy("query", "canon").orderBy(F.char_length("body").desc(), "ord", "rank")
    return cand.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query", "canon", "title", F.col("canon").alias("href"), "body", "engine")


def cap_and_limit(ranked: DataFrame, keys: list[str], per_domain: int, limit: int, by: str = "domain") -> DataFrame:
    """Keep the best ``per_domain`` of a domain (0: all), then the best ``limit`` (none, if it isn't positive), with ``place``."""
    order = [F.desc("score"), F.asc("canon")]
    if per_domain > 0:
        ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, by).orderBy(*order))).where(F.col("_n") <= per_domain).drop("_n")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= limit)


def wikimedia_category(title: Column) -> Column:
    return title.contains("Category:") & title.contains("Wikimedia")


def fuse(hits: DataFrame, weights: DataFrame | None = None, per_domain: int = 0, limit: int = 10) -> DataFrame:
    cand = candidates(hits)
    ranked = best_documents(cand).join(scores(cand, weights), ["query", "canon"]).where(~wikimedia_category(F.col("title")))
    return cap_and_limit(ranked.withColumn("domain", registrable_domain(F.col("canon"))), ["query"], per_domain, limit)


def one_engine_per_provider(hits: DataFrame, engines: DataFrame) -> DataFrame:
    """Of engines with one provider only the first that has hits for a query counts."""
    seen = hits.select("query", "engine").distinct().join(engines, "engine")
    first = seen.groupBy("query", "provider").agg(F.min_by("engine", "ordinal").alias("engine")).select("query", "engine")
    return hits.join(first, ["query", "engine"])


def format_results(ranked: DataFrame) -> DataFrame:
    """One text a query: title, URL and snippet on a line each, results parted by a rule, and a closing sentence."""
    flat = lambda c: collapse_whitespace(F.coalesce(F.col(c), F.lit("")))
    block = F.concat(F.lit("Title: "), flat("title"), F.lit("\nURL: "), flat("href"), F.lit("\nSnippet: "), flat("body"))
    rows = ranked.select("query", F.struct("place", block.alias("block")).alias("b")).groupBy("query").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    rule = "\n\n---\n\n"
    return rows.select("query", F.concat(F.array_join(F.transform("bs", lambda b: b["block"]), rule), F.lit(rule + CLOSING)).alias("text"))


def search_failure(kind: Column, providers: Column, timeout_ms: Column, message: Column) -> Column:
    """What a reader is told of a failed search: ``kind`` is cancelled, timeout, empty or another error."""
    seconds = F.concat(F.lit(" did not respond within "), F.floor(timeout_ms / 1000 + 0.5).cast("string"), F.lit(" seconds."))
    named = F.concat(F.lit(" ("), F.array_join(F.array_sort(providers), ", "), F.lit(")"))
    return (
        F.when(kind == "cancelled", F.lit("Search cancelled."))
        .when(kind == "timeout", F.concat(F.lit("Search failed: the search engines"), F.when(F.coalesce(F.size(providers), F.lit(0)) > 0, named).otherwise(F.lit("")), seconds))
        .when((kind == "empty") | message.contains("No results found"), F.lit(NO_RESULTS))
        .otherwise(F.concat(F.lit("Search failed: "), message))
    )


def sweep_stats(sweeps: DataFrame) -> DataFrame:
    """One record a sweep (query, max_results, started_ms, ended_ms, timed_out, results) as it is logged."""
    return sweeps.select(
        F.date_format(F.timestamp_millis("ended_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        "query",
        F.col("max_results").alias("maxResults"),
        (F.col("ended_ms") - F.col("started_ms")).alias("durationMs"),
        F.array_sort(F.array_distinct("timed_out")).alias("timedOutProviders"),
        F.col("results").alias("resultCount"),
    )


def write_stats(sweeps: DataFrame, path: str) -> None:
    """Append the records as lines of JSON."""
    sweep_stats(sweeps).write.mode("append").json(path)
