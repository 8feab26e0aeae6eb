"""The registered queries of the ten operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import ann, html_blocks, licenses, ngram_join, packing, pieces, quality, sharding, suffix_dedup, url_rules
from weftline.llm.common import table

# The contract's host/path rules.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", F.expr("quality = 0 or toxic = 1").alias("bad"))
    return url_rules.judge_urls(pages, url_rules.mine_rules(labelled), URL_RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("thash")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_rules, op2_packing, op3_ngram_join, op4_sharding, op5_quality_rules, op6_suffix_dedup, op7_ann, op8_pieces, op9_html_blocks, op10_licenses)}


def _quality_sql(width: int = 3, prior: int = 100) -> str:
    metrics = quality.METRICS
    stacked = " union all ".join(f"select lang, source, '{m}' as metric, {m} as v from measured where not base_failed" for m in metrics)
    limits = ", ".join(
        f"max(case when metric = '{m}' then q3 + {width} * greatest(q3 - q1, {least}) end) as {m}_high, max(case when metric = '{m}' then q1 - {width} * greatest(q3 - q1, {least}) end) as {m}_low" for m, (least, _) in metrics.items()
    )
    bad = " or ".join(f"coalesce({m} > {m}_high, false)" + (f" or coalesce({m} < {m}_low, false)" if both else "") for m, (_, both) in metrics.items())

    def quartiles(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        on = f"partition by {by}metric"
        return f"""{name} as (select {by}metric, max(total) as n_rows, min(case when upto * 4 >= total then bucket end) as q1, min(case when upto * 4 >= total * 3 then bucket end) as q3
            from (select {by}metric, bucket, sum(n) over ({on}) as total, sum(n) over ({on} order by bucket rows unbounded preceding) as upto
                  from (select {by}metric, bucket, sum(n) as n from hist group by {by}metric, bucket)) group by {by}metric)"""

    pick = lambda q: f"(o.n_rows * o.{q} + {prior} * ((l.n_rows * l.{q} + {prior} * a.{q}) // (l.n_rows + {prior}))) // (o.n_rows + {prior}) as {q}"
    gap = r"[\x20\x09-\x0D]+"
    return f"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select r, doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
pos as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
win as (select r, i, concat_ws(' ', word, lead(word, 1) over s, lead(word, 2) over s, lead(word, 3) over s, lead(word, 4) over s, lead(word, 5) over s, lead(word, 6) over s, lead(word, 7) over s) as g,
               lead(word, 7) over s as last, lead(word, 1) over s = word as stutter from pos window s as (partition by r order by i)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win where last is not null) where c > 1),
cover as (select r, count(distinct i + k) as n_repeat_words from again, (select unnest(range(8)) as k) group by r),
st as (select r, count(*) filter (stutter) as n_stutters from win group by r),
base as (select w.r, doc_id, lang, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
                len(ls) as n_lines, len(regexp_extract_all(t, '!')) as n_exclaims, coalesce(n_stutters, 0) as n_stutters
         from w left join cover on w.r = cover.r left join st on w.r = st.r),
measured as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, 1000 * n_symbols // greatest(n_words, 1) as symbols, 1000 * n_exclaims // greatest(n_words, 1) as exclaims,
                    1000 * n_stutters // greatest(n_words, 1) as stutter, 1000 * n_dup_lines // greatest(n_lines, 1) as dup_lines, 1000 * word_chars // greatest(n_words, 1) as word_len from base),
hist as (select lang, source, metric, ((v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0)) as bucket, count(*) as n from ({stacked}) group by all),
{quartiles("own", "lang, source")}, {quartiles("langs", "lang")}, {quartiles("whole", "")},
chosen as (select o.lang, o.source, o.metric, {pick("q1")}, {pick("q3")} from own o join langs l on o.metric = l.metric and o.lang is not distinct from l.lang join whole a on o.metric = a.metric),
lim as (select lang, source, {limits} from chosen group by lang, source)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed or {bad}) as kept, {", ".join(f"{m}::bigint as {m}" for m in metrics)}
from measured m left join lim on m.lang is not distinct from lim.lang and m.source is not distinct from lim.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": _quality_sql()}
