"""A search as one plan: queries are scoped by the policy, a client gives hits, these are fused, filtered and written.

The client is any function from queries (query, scoped) to hits (query, engine, ord, rank, title, href, body): result
pages that were captured, a table, a service. All engines' lists count; no deadline stops them early.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.hosts import policy_domains
from weftline.functions.text import collapse_whitespace
from weftline.functions.urls import check_access, scope_query
from weftline.operators import fusion
from weftline.sources import serp

Client = Callable[[DataFrame], DataFrame]


def engine_table(spark: SparkSession, names: list[str] | None = None, rendering: bool = False) -> DataFrame:
    """(engine, provider, ordinal) of the engines that a search asks."""
    return spark.createDataFrame([(n, serp.ENGINES[n].provider, serp.ENGINES[n].ordinal) for n in serp.selected(names, rendering)], "engine string, provider string, ordinal int")


def captured(pages: DataFrame, names: list[str] | None = None, rendering: bool = False) -> Client:
    """A client over result pages (query, engine, html) of the engines asked, one engine a provider."""

    def client(queries: DataFrame) -> DataFrame:
        engines = engine_table(pages.sparkSession, names, rendering)
        hits = serp.serp_hits(pages.join(queries.select("query"), "query", "left_semi")).join(F.broadcast(engines), "engine")  # a handful of engines
        return fusion.one_engine_per_provider(hits.drop("provider", "ordinal"), engines).join(F.broadcast(engines.select("engine", F.col("ordinal").alias("ord"))), "engine")

    return client


def search(queries: DataFrame, client: Client, max_results: float | None = None, weights: DataFrame | None = None, per_domain: int = 0, allowed: list[str] | None = None, blocked: list[str] | None = None) -> DataFrame:
    """``queries`` (query) to (query, text): the results as text, or why there are none."""
    only, never = policy_domains(allowed), policy_domains(blocked)
    valid = only is not None and never is not None
    asked = queries.select("query").distinct()
    fine = asked.where(collapse_whitespace(F.coalesce("query", F.lit(""))) != "").withColumn("scoped", scope_query(F.col("query"), only or []))
    ranked = fusion.fuse(client(fine), weights, per_domain, limit=1 << 30)
    found = ranked.select("query").distinct().withColumn("_found", F.lit(True))
    fits = ranked.where(check_access(F.col("href"), only if valid else [], never if valid else [], valid)["allowed"])
    text = fusion.format_results(fusion.cap_and_limit(fits.drop("place"), ["query"], 0, fusion.clamp_results(max_results)))
    rows = asked.join(text, "query", "left").join(found, "query", "left")
    blank = collapse_whitespace(F.coalesce("query", F.lit(""))) == ""
    none = F.when(blank, F.lit("No query provided.")).when(F.col("_found").isNull(), F.lit(fusion.NO_RESULTS)).otherwise(F.lit(fusion.NONE_ALLOWED))
    return rows.select("query", F.coalesce("text", none).alias("text"))
