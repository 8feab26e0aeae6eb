"""URL filters by association rules.

FP-growth mines combinations of URL tokens from labelled URLs; rules that predict ``block`` with enough support,
confidence and lift (confidence over the share of bad URLs among all) are kept, unless a shorter rule already says as
much. A rule is posted in an inverted index under its rarest token, so a URL meets only rules of which it holds that
token, and the other tokens are verified by a set difference. Fixed host/path rules go first, longest wins.

All labelled rows and all their tokens are mined; left out are only tokens that lie in too few bad URLs to be in any
rule with the support asked for, which changes no rule. ``min_support`` bounds the number of itemsets.

Awkward rows: a null url, or one without ``://``, has empty host and path, no tokens and the verdict ``allow``; long
urls are read whole; labelled rows with a null url or label teach nothing; repeated rows count as often as they come
and are judged one by one; of mined rules that fit, the highest confidence counts; an empty table gives no rows, and
without labelled rows no rule is mined and everything unmatched is allowed; other columns are not read, so their
names don't matter.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCK = "label=block"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, words of the path (runs of digits as one class) and query keys."""
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    hosts = F.transform(F.split(host_of(url), r"[.\-]"), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.regexp_replace(F.lower(path_of(url)), r"[0-9]+", "0"), r"[^a-z0-9]+"), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.split(tail, "&"), lambda x: F.concat(F.lit("q:"), F.lower(F.substring_index(x, "=", 1))))
    return F.filter(F.array_distinct(F.concat(hosts, words, keys)), lambda x: F.length(x) > 2)


RULES = "tokens array<string>, anchor string, confidence double, support double"


def mine_rules(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.6, min_lift: float = 1.5, min_count: float = 10.0) -> DataFrame:
    """Rules (tokens, anchor, confidence, support) from ``labelled`` (url string, bad boolean)."""
    rows = labelled.where("url is not null and bad is not null").select(url_tokens(F.col("url")).alias("tokens"), F.col("bad").cast("int").alias("bad"))
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")).first()
    total, n_bad = sums["n"], sums["n_bad"]
    if not n_bad:
        return labelled.sparkSession.createDataFrame([], RULES)
    least = max(min_count, min_support * total)
    seen = rows.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("token_n"), F.sum("bad").alias("token_bad"))
    useful = materialize(seen.where(F.col("token_bad") >= least).select("token", "token_n"), "url-tokens")
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    kept = numbered.select("row", "bad", F.explode("tokens").alias("token")).join(useful.select("token"), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("tokens"))
    kept = materialize(kept.select(F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items")), "url-baskets")
    held = kept.count()
    if not held:
        return labelled.sparkSession.createDataFrame([], RULES)
    # A hair below the count asked for, which the miner rounds up.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 1e-6) / held), minConfidence=min_confidence).fit(kept)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.col("confidence") >= min_lift * n_bad / total))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * held / total).alias("support")), "url-rules")
    each = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(useful, "token")
    indexed = each.groupBy("tokens", "confidence", "support").agg(F.min_by("token", F.struct("token_n", "token")).alias("anchor"))
    shorter = indexed.select(F.col("tokens").alias("part"), F.col("anchor").alias("token"), F.col("confidence").alias("other"))
    covered = each.join(shorter, "token").where((F.size("part") < F.size("tokens")) & (F.col("other") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0))
    return materialize(indexed.join(covered.select("tokens").distinct(), "tokens", "left_anti").select("tokens", "anchor", "confidence", "support"), "url-mined")


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (len, rule, verdict) of the longest fitting (verdict, host, path) rule, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.greatest(*fits, F.lit(None).cast("struct<len:int,rule:string,verdict:string>")) if fits else F.lit(None).cast("struct<len:int,rule:string,verdict:string>")


def judge_urls(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (page_id, url, ...) to page_id, host, path, rule, verdict, confidence (of the mined rule that blocks)."""
    urls = pages.where("url is not null").select("url").distinct().select("url", url_tokens(F.col("url")).alias("has"))
    met = (
        urls.select("url", "has", F.explode("has").alias("anchor"))
        .join(mined, "anchor")
        .where(F.size(F.array_except("tokens", "has")) == 0)
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return (
        pages.select("page_id", "url")
        .join(met, "url", "left")
        .select("page_id", host.alias("host"), path.alias("path"), "confidence")
        .withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
        .select(
            "page_id",
            "host",
            "path",
            F.col("fixed.rule").alias("rule"),
            F.coalesce(F.col("fixed.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
            "confidence",
        )
    )
