"""Quality rules with adaptive thresholds.

Every document gets integer metrics in thousandths. For each language and source a log-linear histogram
(six significant bits, so quantiles are off by at most 1/32 of their value) serves as quantile sketch:
histograms of groups add up to those of a language and of the corpus. A group's quartiles are pooled with its
language's, weighted as if the language's came from ``prior`` rows more, and those with the corpus's likewise; so
small groups lean on their language and large ones on themselves, without a switch. A limit lies ``width``
interquartile ranges beyond a quartile (with a least range per metric); documents are joined to their group's limits
and fail beyond any of them.

Awkward rows: a null or empty text has no words and fails the base rule; very long texts are measured whole; null
languages or sources form groups of their own; repeated rows are judged one by one, and a value at the limit (a tie)
passes; an empty table gives an empty result; ``apply_rules`` hands other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
SPAN = 8
#: metric: (least interquartile range in thousandths, lower limit too)
METRICS = {"symbols": (30, False), "exclaims": (50, False), "stutter": (30, False), "dup_lines": (150, False), "word_len": (1000, True)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _pairs(xs: Column, step: int, f) -> Column:
    n = F.greatest(F.size(xs) - step, F.lit(0))
    return F.zip_with(F.slice(xs, 1, n), F.slice(xs, 1 + step, n), f)


def _covered(hashes: Column) -> Column:
    """Words lying in windows whose hash occurs more than once; ``hashes`` by window start."""

    def count(by_hash: Column) -> Column:
        m = F.size(by_hash)
        h = lambda i: F.get(by_hash, i)["h"]
        again = F.filter(F.sequence(F.lit(0), m - 1), lambda i: F.coalesce(h(i) == h(i + 1), F.lit(False)) | F.coalesce((i > 0) & (h(i) == h(F.greatest(i - 1, F.lit(0)))), F.lit(False)))
        at = F.array_sort(F.transform(again, lambda i: F.get(by_hash, i)["at"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        step = lambda a, p: F.struct((p + SPAN).alias("end"), (a["sum"] + p + SPAN - F.greatest(p, a["end"])).alias("sum"))
        return F.aggregate(at, start, step, lambda a: a["sum"])

    by_hash = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    return F.get(F.transform(F.array(by_hash), count), F.lit(0))


def measure(docs: DataFrame, kept: str | None = None) -> DataFrame:
    """The rows' base counts and metrics next to doc_id, lang and source, or to one struct ``kept`` of all columns."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(kept)] if kept else [F.col("doc_id")]
    words = docs.select(*whole, F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.coalesce("text", F.lit("")).alias("_text"))
    words = words.withColumn("_words", F.filter(F.split("_text", WORD_GAP), lambda w: w != ""))
    hashed = words.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    )
    pair = lambda xs, k: _pairs(xs, k, lambda a, b: F.xxhash64(a, b))
    hashed = hashed.withColumn("_w2", pair(F.col("_h"), 1)).withColumn("_w4", pair(F.col("_w2"), 2)).withColumn("_w8", pair(F.col("_w4"), 4))
    first = [kept or "doc_id", F.col("_lang").alias("lang"), F.col("_source").alias("source")]
    base = hashed.select(
        *first,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_w8")) == F.size("_w8"), F.lit(0)).otherwise(_covered(F.col("_w8"))).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclaims"),
        F.size(F.filter(_pairs(F.col("_h"), 1, lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutters"),
    )
    each = lambda top, bottom: F.expr(f"1000 * {top} div greatest({bottom}, 1)")
    return base.select(
        kept or "doc_id",
        "lang",
        "source",
        *BASE,
        F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
        each("n_symbols", "n_words").alias("symbols"),
        each("n_exclaims", "n_words").alias("exclaims"),
        each("n_stutters", "n_words").alias("stutter"),
        each("n_dup_lines", "n_lines").alias("dup_lines"),
        each("word_chars", "n_words").alias("word_len"),
    )


def sketch(measured: DataFrame) -> DataFrame:
    """Histogram rows (lang, source, metric, bucket, n) of the documents that pass the base rule."""
    stacked = measured.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("e"))
    return stacked.select("lang", "source", "e.metric", "e.v").withColumn("bucket", F.expr("shiftleft(shiftright(v, greatest(length(bin(v)) - 6, 0)), greatest(length(bin(v)) - 6, 0))")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def _quartiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    merged = hist.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("total", F.sum("n").over(of)).withColumn("upto", F.sum("n").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("rows"), q(1).alias("q1"), q(3).alias("q3"))


def limits(hist: DataFrame, width: int = 3, prior: int = 100) -> DataFrame:
    """One row (lang, source, <metric>_low, <metric>_high) per group, from its quartiles pooled with its language's and the corpus's."""
    own, lang, whole = _quartiles(hist, ["lang", "source"]), _quartiles(hist, ["lang"]), _quartiles(hist, [])
    up = lambda df, p: df.select(*[c for c in df.columns if c in ("lang", "metric")], *[F.col(c).alias(f"{p}_{c}") for c in ("rows", "q1", "q3")])
    both = own.alias("o").join(up(lang, "lang").withColumnRenamed("lang", "_lang").alias("l"), F.col("o.lang").eqNullSafe(F.col("_lang")) & (F.col("o.metric") == F.col("l.metric"))).select("o.*", "lang_rows", "lang_q1", "lang_q3")
    both = both.join(up(whole, "all"), "metric")
    pool = lambda n, q, wider: F.expr(f"({n} * {q} + {prior} * ({wider})) div ({n} + {prior})")
    chosen = both.select("lang", "source", "metric", *[pool("rows", q, f"(lang_rows * lang_{q} + {prior} * all_{q}) div (lang_rows + {prior})").alias(q) for q in ("q1", "q3")])
    at = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    gap = lambda least: F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * width
    return chosen.groupBy("lang", "source").agg(
        *[at(m, F.col("q3") + gap(least)).alias(f"{m}_high") for m, (least, _) in METRICS.items()],
        *[at(m, F.col("q1") - gap(least)).alias(f"{m}_low") for m, (least, both) in METRICS.items() if both],
    )


def _limits_of(measured: DataFrame, width: int, prior: int) -> DataFrame:
    """The limits as a written table: its size is known then, so the join sends it to the rows while it is small, and deals out the rows only beyond that."""
    return materialize(limits(sketch(measured), width, prior), "quality-limits")


def judge(measured: DataFrame, lim: DataFrame) -> DataFrame:
    """``measured`` with ``kept``."""
    lim = lim.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(lim, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    bad = F.col("base_failed")
    for m, (_, both) in METRICS.items():
        bad = bad | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
        if both:
            bad = bad | F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))
    return joined.select(*measured.columns, (~bad).alias("kept"))


def apply_rules(docs: DataFrame, width: int = 3, prior: int = 100) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source and what else there is) that the rules keep, with their columns; the measured table is written once and read twice."""
    measured = materialize(measure(docs, "_doc"), "quality")
    return judge(measured, _limits_of(measured, width, prior)).where("kept").select("_doc.*")


def quality_rules(docs: DataFrame, width: int = 3, prior: int = 100) -> DataFrame:
    """The digest: doc_id, base counts, base_failed, kept and the metrics."""
    measured = materialize(measure(docs.select("doc_id", "text", "lang", "source")), "quality")
    return judge(measured, _limits_of(measured, width, prior)).select("doc_id", *BASE, "base_failed", "kept", *METRICS)
