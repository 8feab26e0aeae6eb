"""Evaluation of engine runs against labelled queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.urls import domain_of_host, host
from weftline.operators.fusion import cap_and_limit, scores

# Weights of the engines and caps a domain that the grid tries.
WEIGHT_VECTORS = {
    "uniform": {"duckduckgo": 1, "yandex": 1, "startpage": 1},
    "startpage-heavy": {"startpage": 2, "duckduckgo": 1.5, "yandex": 0.75},
    "duckduckgo-heavy": {"duckduckgo": 2, "startpage": 1.5, "yandex": 0.75},
    "yandex-heavy": {"yandex": 2, "startpage": 1.5, "duckduckgo": 1.5},
}
PER_HOST_CHOICES = [0, 1, 2, 4, 5]
RUN = "query string, engine string, run struct<results:array<struct<title:string,href:string,body:string>>,ms:bigint,error:string>"


def labels(golden: DataFrame) -> DataFrame:
    """``golden`` (query, expected), one row a label, to one row a query: what is expected is a set."""
    return golden.groupBy("query").agg(F.collect_set("expected").alias("_expected"))


def is_expected(domain: Column, expected: Column) -> Column:
    """Whether a domain is one of those expected, or below one."""
    return F.coalesce(F.exists(expected, lambda e: (domain == e) | domain.endswith(F.concat(F.lit("."), e))), F.lit(False))


def precision(top: DataFrame, golden: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over ``queries`` of the share of ``top`` (keys, query, domain) whose domain is expected; a query without results has 0."""
    hit = top.join(labels(golden), "query", "left").withColumn("hit", is_expected(F.col("domain"), F.col("_expected")).cast("int"))
    each = hit.groupBy(*keys, "query").agg(F.avg("hit").alias("p"))
    n = queries.select("query").distinct().agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.sum("p").alias("p")).crossJoin(F.broadcast(n)).select(*keys, F.round(F.col("p") / F.col("n"), 9).alias("precision"))  # n is one row


def upper_median(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Element floor(n/2) of the sorted values, counted from 0: in descending order the first that half of them reach."""
    return runs.groupBy(key).agg(F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)").alias("median"))


def failures(runs: DataFrame, key: str = "engine") -> DataFrame:
    """``runs`` (key, error, results) to the number of runs and of those with an error or without results."""
    failed = (F.coalesce("error", F.lit("")) != "") | (F.coalesce("results", F.lit(0)) == 0)
    return runs.groupBy(key).agg(F.count_if(failed).alias("failures"), F.count("*").alias("runs"))


def jaccard(runs: DataFrame) -> DataFrame:
    """``runs`` (query, engine, canon): mean over queries of |A and B| / |A or B| for each ordered pair of engines."""
    each = runs.select("query", "engine", "canon").distinct()
    size = each.groupBy("query", "engine").agg(F.count("*").alias("n"))
    left, right = [size.withColumnsRenamed({"engine": e, "n": f"n_{e}"}) for e in ("a", "b")]
    both = each.withColumnRenamed("engine", "a").join(each.withColumnRenamed("engine", "b"), ["query", "canon"]).groupBy("query", "a", "b").agg(F.count("*").alias("both"))
    pairs = left.join(right, "query").where("a <> b").join(both, ["query", "a", "b"], "left")
    share = F.coalesce("both", F.lit(0)) / (F.col("n_a") + F.col("n_b") - F.coalesce("both", F.lit(0)))
    return pairs.groupBy("a", "b").agg(F.round(F.avg(share), 9).alias("jaccard"))


def unique_contribution(runs: DataFrame, golden: DataFrame | None = None) -> DataFrame:
    """Per engine: list positions, those whose URL no other engine has, and with ``golden`` how many of these are expected."""
    engines = runs.select("query", "canon", "engine").distinct().groupBy("query", "canon").agg(F.count("*").alias("engines"))
    joined = runs.join(engines, ["query", "canon"]).withColumn("_own", F.col("engines") == 1)
    counts = [F.count("*").alias("total"), F.count_if("_own").alias("unique_urls")]
    if golden is not None:
        joined = joined.join(labels(golden), "query", "left").withColumn("_hit", F.col("_own") & is_expected(F.col("domain"), F.col("_expected")))
        counts.append(F.count_if("_hit").alias("unique_expected"))
    return joined.groupBy("engine").agg(*counts)


def weights(spark: SparkSession, vectors: dict[str, dict[str, float]] = WEIGHT_VECTORS) -> DataFrame:
    return spark.createDataFrame([(v, e, float(w)) for v, of in vectors.items() for e, w in of.items()], "vector string, engine string, w double")


def grid_top(cand: DataFrame, weight: DataFrame, caps: DataFrame, limit: int = 5) -> DataFrame:
    """The fused top of every query for each weight vector and cap; one plan, no loop over cells."""
    ranked = scores(cand, weight).withColumn("domain", domain_of_host(host(F.col("canon")))).join(F.broadcast(caps))  # the grid's sides are parameters
    keys, order = ["vector", "cap", "query"], [F.desc("score"), F.asc("canon")]
    kept = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "domain").orderBy(*order))).where("cap = 0 or _n <= cap").drop("_n")
    return cap_and_limit(kept, keys, 0, limit)


def grid(cand: DataFrame, weight: DataFrame, caps: DataFrame, golden: DataFrame, limit: int = 5) -> DataFrame:
    """Precision and mean distinct domains for each weight vector and cap."""
    top = grid_top(cand, weight, caps, limit)
    p = precision(top.select("vector", "cap", "query", "domain"), golden, cand.select("query"), ["vector", "cap"])
    spread = top.groupBy("vector", "cap", "query").agg(F.countDistinct("domain").alias("d")).groupBy("vector", "cap").agg(F.round(F.avg("d"), 9).alias("domains"))
    return p.join(spread, ["vector", "cap"])


def engine_mix(top: DataFrame, cand: DataFrame) -> DataFrame:
    """For each weight vector and cap how many of ``top`` an engine owns: the first (by ``ord``) that has the URL."""
    owner = cand.groupBy("query", "canon").agg(F.min_by("engine", "ord").alias("engine"))
    return top.join(owner, ["query", "canon"]).groupBy("vector", "cap", "engine").agg(F.count("*").alias("n"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs, {query, engine, run} in a JSON array or a line each, to one row a result (rank from 1; runs without results keep one row)."""
    rows = spark.read.schema(RUN).json(path)  # an array on one line or records on lines
    return rows.select("query", "engine", F.col("run.ms").alias("ms"), F.col("run.error").alias("error"), F.posexplode_outer("run.results").alias("pos", "hit")).select("query", "engine", "ms", "error", (F.col("pos") + 1).alias("rank"), "hit.*")


def write_runs(runs: DataFrame, path: str) -> None:
    """``runs`` (query, engine, ms, error, rank, title, href, body) as records of {query, engine, run}."""
    hits = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "title", "href", "body"))))
    own = F.transform(hits, lambda h: F.struct(h["title"].alias("title"), h["href"].alias("href"), h["body"].alias("body")))
    rows = runs.groupBy("query", "engine").agg(own.alias("results"), F.first("ms").alias("ms"), F.first("error").alias("error"))
    rows.select("query", "engine", F.struct("results", "ms", "error").alias("run")).write.mode("overwrite").json(path)
