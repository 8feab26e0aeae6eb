"""Settings from JSON documents in layers: of each key the last layer that holds a valid value wins.

Every logical key has paths under which older documents may hold it; in a layer the first path with a value of the
right type counts. All of it is columns over the documents, one row a key in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The logical keys with their names, the sections (and whole paths) under which they may stand, and what makes a value ``v`` valid.
KEYS = {
    "max_results": (["maxResults", "webSearch.maxResults", "smartWebSearch.resultsPerQuery"], "number", "true"),
    "max_chars": (["maxChars", "webFetch.maxChars", "smartFetchDefaultMaxChars"], "number", "v > 0"),
    "timeout_ms": (["timeoutMs", "webFetch.timeoutMs", "smartFetchDefaultTimeoutMs"], "number", "v >= 1000"),
    "allow_private_addresses": (["allowPrivateAddresses", "webFetch.allowPrivateAddresses"], "boolean", "true"),
    "allow_local_files": (["allowLocalFiles", "webFetch.allowLocalFiles"], "boolean", "true"),
    "transport": (["transport", "webFetch.transport"], "string", "v in ('tls-first', 'direct-first', 'off')"),
    "renderer_enabled": (["lightpandaEnabled", "webRender.lightpandaEnabled"], "boolean", "true"),
    "renderer_path": (["lightpandaPath", "webRender.lightpandaPath"], "string", "true"),
    "renderer_command": (["lightpandaCommand", "webRender.lightpandaCommand"], "strings", "true"),
    "engine_weights": (["engineWeights", "webSearch.engineWeights"], "weights", "true"),
    "max_per_host": (["maxPerHost", "webSearch.maxPerHost"], "number", "v >= 0"),
    "engines": (["engines", "webSearch.engines"], "strings", "true"),
    "render_fallback": (["lightpandaFallback", "webSearch.lightpandaFallback"], "boolean", "true"),
}
DEFAULTS = {"max_results": "5", "timeout_ms": "60000", "allow_private_addresses": "true", "allow_local_files": "true", "transport": "tls-first", "renderer_enabled": "true"}


def _value(document: Column, path: str, kind: str) -> Column:
    """What a path holds, as text, if it is of the kind; else null."""
    found = F.try_variant_get(document, "$." + path, "variant")
    is_ = F.schema_of_variant(found)
    if kind == "number":
        return F.when(is_.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.floor(found.try_cast("double")).cast("string"))
    if kind == "boolean":
        return F.when(is_ == "BOOLEAN", found.cast("string"))
    if kind == "string":
        text = F.trim(found.try_cast("string"))
        return F.when((is_ == "STRING") & (text != ""), text)
    if kind == "strings":
        each = F.transform(F.try_variant_get(document, "$." + path, "array<variant>"), lambda v: F.when((F.schema_of_variant(v) == "STRING") & (F.trim(v.try_cast("string")) != ""), v.try_cast("string")))
        kept = F.filter(each, lambda v: v.isNotNull())
        return F.when(is_.startswith("ARRAY") & (F.size(kept) > 0), F.to_json(kept))
    weights = F.map_filter(F.try_variant_get(document, "$." + path, "map<string,variant>"), lambda _, v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (v.try_cast("double") > 0))
    kept = F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(weights, lambda _, v: v.try_cast("double")))))
    return F.when(is_.startswith("OBJECT") & (F.size(weights) > 0), F.to_json(kept))


def layered(docs: DataFrame, section: str = "webTools", keys: dict[str, tuple[list[str], str, str]] = KEYS, defaults: dict[str, str] | None = None) -> DataFrame:
    """``docs`` (precedence, json), whose own section is ``section`` (a key's first path stands in it), to (key, value, precedence): per key the valid value of the highest precedence (with ``defaults`` below all); numbers are whole, results 1 to 20. What is no JSON object holds nothing."""
    parsed = docs.withColumn("_doc", F.try_parse_json("json"))
    found = []
    for key, (paths, kind, valid) in keys.items():
        value = F.coalesce(*[_value(F.col("_doc"), p if k else f"{section}.{p}", kind) for k, p in enumerate(paths)])
        number = value.try_cast("double") if kind == "number" else value
        fits = F.expr(valid.replace("v ", "_v ")) if valid != "true" else F.lit(True)
        rows = parsed.select("precedence", F.lit(key).alias("key"), value.alias("value"), number.alias("_v")).where(F.col("value").isNotNull() & fits).drop("_v")
        if key == "max_results":
            rows = rows.withColumn("value", F.least(F.lit(20), F.greatest(F.lit(1), F.col("value").cast("bigint"))).cast("string"))
        found.append(rows)
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    if defaults:
        below = docs.sparkSession.createDataFrame([(-1, k, v) for k, v in defaults.items()], "precedence int, key string, value string")
        out = out.unionByName(below)
    return out.groupBy("key").agg(F.max_by("value", "precedence").alias("value"), F.max("precedence").alias("precedence"))


def read_settings(spark: SparkSession, paths: list[str], section: str = "webTools", keys: dict = KEYS, defaults: dict[str, str] | None = DEFAULTS) -> DataFrame:
    """The settings of files in order, later ones over earlier ones; files that aren't there are none."""
    docs = spark.createDataFrame([], "precedence int, json string")
    for k, path in enumerate(paths):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            docs = docs.unionByName(spark.read.text(path, wholetext=True).select(F.lit(k).alias("precedence"), F.col("value").alias("json")))
    return layered(docs, section, keys, defaults)
