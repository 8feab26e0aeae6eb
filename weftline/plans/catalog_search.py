"""Queries over result lists: fusion, evaluation, result pages, the cache, and what is logged. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import cache, evaluate, fusion
from weftline.plans import search
from weftline.plans.registry import ALLOWED, CANON, canon_sql, domain_sql, in_sql, literal, part_sql, query, table, turn_sql
from weftline.sources import serp

ENGINES = ["duckduckgo", "yandex", "startpage"]

# Three engines rank the pages of a language: by length of html, by canonical URL, by id.
_HITS_SQL = f"""hits as (
select query, engine, ord, row_number() over (partition by query, engine order by k1 desc, k2, page_id) as rank, title, href, body, canon, page_id from (
select p.*, e.engine, e.ord, case ord when 1 then length(html) else 0 end as k1, case ord when 2 then canon else '' end as k2 from
 (select page_id, split_part(url, '/', 4) as query, url as href, {CANON} as canon, html,
   trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\s]+', ' ', 'g')) as title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as body from pages) p,
 (values ('duckduckgo', 1), ('yandex', 2), ('startpage', 3)) e(engine, ord))),
f as (select query, engine, canon, min(rank) as rank from hits group by all)"""


def _hits(spark, sf_dir) -> DataFrame:
    """The engines' lists; a body is the whole article, which engine ``ord`` 2 and 3 carry once more as it is."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.split_part("url", F.lit("/"), F.lit(4)).alias("query"), F.col("url").alias("href"), U.canonicalize(F.col("url")).alias("canon"), F.char_length("html").alias("n"), T.page_title(F.col("html")).alias("title"), F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("body")
    )
    engines = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(k).alias("ord")) for k, e in enumerate(ENGINES, 1)])).alias("e")
    every = pages.select("*", engines).select("*", "e.*").drop("e")
    order = [F.when(F.col("ord") == 1, F.col("n")).otherwise(0).desc(), F.when(F.col("ord") == 2, F.col("canon")).otherwise(F.lit("")), "page_id"]
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query", "engine").orderBy(*order))).drop("n", "canon")


_WEIGHTS = [("duckduckgo", 1.0), ("yandex", 0.5)]


@query(f"with {_HITS_SQL} select query, canon, round(sum(1.0 / (60 + rank)), 12) as score from f group by query, canon")
def rrf_scores(spark, sf_dir):
    return fusion.scores(fusion.candidates(_hits(spark, sf_dir)))


@query(f"with {_HITS_SQL} select query, canon, round(sum(coalesce(w, 1.0) / (60 + rank)), 12) as score from f left join (values ('duckduckgo', 1.0), ('yandex', 0.5)) v(engine, w) using (engine) group by query, canon")
def rrf_weighted(spark, sf_dir):
    return fusion.scores(fusion.candidates(_hits(spark, sf_dir)), spark.createDataFrame(_WEIGHTS, "engine string, w double"))


def _topk_sql(cap: int, limit: int, by: str = "domain") -> str:
    host = part_sql("canon", 2)
    key = {"domain": domain_sql(host), "host": host}[by]
    return f"""with {_HITS_SQL}, s as (select query, canon, round(sum(1.0 / (60 + rank)), 12) as score, {key} as {by} from f group by query, canon),
c as (select *, row_number() over (partition by query, {by} order by score desc, canon) as n from s)
select query, canon, {by}, score, place from (select *, row_number() over (partition by query order by score desc, canon) as place from c where n <= {cap} or {cap} = 0) where place <= {limit}"""


@query(_topk_sql(2, 10))
def rrf_topk(spark, sf_dir):
    return fusion.fuse(_hits(spark, sf_dir), per_domain=2, limit=10).select("query", F.col("href").alias("canon"), "domain", "score", "place")


@query(_topk_sql(1, 5, "host"))
def host_cap(spark, sf_dir):
    scored = fusion.scores(fusion.candidates(_hits(spark, sf_dir))).withColumn("host", U.host(F.col("canon")))
    return fusion.cap_and_limit(scored, ["query"], 1, 5, by="host").select("query", "canon", "host", "score", "place")


@query(f"with {_HITS_SQL} select query, canon, title, canon as href, body, engine from (select *, row_number() over (partition by query, canon order by length(body) desc, ord, rank) as n from hits) where n = 1")
def longest_body_dedupe(spark, sf_dir):
    return fusion.best_documents(fusion.candidates(_hits(spark, sf_dir)))


@query(f"with {_HITS_SQL} select query, engine, rank, href from hits where engine in ('duckduckgo', 'startpage')")
def provider_dedupe(spark, sf_dir):
    engines = spark.createDataFrame([("duckduckgo", "one", 1), ("yandex", "one", 2), ("startpage", "two", 3)], "engine string, provider string, ordinal int")
    return fusion.one_engine_per_provider(_hits(spark, sf_dir), engines).select("query", "engine", "rank", "href")


@query(f"""with {_HITS_SQL}, s as (select query, canon, round(sum(1.0 / (60 + rank)), 12) as score from f group by query, canon)
select query, canon, score, place from (select *, row_number() over (partition by query order by score desc, canon) as place from s where {in_sql(part_sql("canon", 2), ALLOWED)}) where place <= 5""")
def policy_refill(spark, sf_dir):
    scored = fusion.scores(fusion.candidates(_hits(spark, sf_dir))).where(U.policy_allows(U.host(F.col("canon")), ALLOWED, []))
    return fusion.cap_and_limit(scored, ["query"], 0, 5).select("query", "canon", "score", "place")


_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"""with {_HITS_SQL}, s as (select query, canon, round(sum(1.0 / (60 + rank)), 12) as score from f group by query, canon),
d as (select query, canon, title, body from (select *, row_number() over (partition by query, canon order by length(body) desc, ord, rank) as n from hits) where n = 1),
t as (select *, row_number() over (partition by query order by score desc, canon) as place from s join d using (query, canon))
select query, string_agg('Title: ' || {_FLAT.format("title")} || chr(10) || 'URL: ' || {_FLAT.format("canon")} || chr(10) || 'Snippet: ' || {_FLAT.format("body")}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place)
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'These are only short snippets. To read a page, call web_fetch with its URL.' as text
from t where place <= 5 group by query""")
def format_results(spark, sf_dir):
    return fusion.format_results(fusion.fuse(_hits(spark, sf_dir), limit=5))


@query(f"""with {_HITS_SQL}, s as (select query, canon, round(sum(1.0 / (60 + rank)), 12) as score from f where query <> 'fr' group by query, canon),
d as (select query, canon, title, body from (select *, row_number() over (partition by query, canon order by length(body) desc, ord, rank) as n from hits) where n = 1),
t as (select *, row_number() over (partition by query order by score desc, canon) as place from s join d using (query, canon) where {in_sql(part_sql("canon", 2), ALLOWED)} and query <> 'de'),
r as (select query, string_agg('Title: ' || {_FLAT.format("title")} || chr(10) || 'URL: ' || {_FLAT.format("canon")} || chr(10) || 'Snippet: ' || {_FLAT.format("body")}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place)
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'These are only short snippets. To read a page, call web_fetch with its URL.' as text from t where place <= 3 group by query)
select q.query, coalesce(text, case q.query when ' ' then 'No query provided.' when 'de' then 'No results found within the website access limits.' else 'No results found.' end) as text from (select distinct query from hits union all values (' ')) q left join r using (query)""")
def web_search(spark, sf_dir):
    """Whole searches under a policy: one query finds nothing, one nothing that is allowed, one is blank."""
    hits = _hits(spark, sf_dir)
    queries = hits.select("query").distinct().unionByName(spark.createDataFrame([(" ",)], "query string"))
    far = F.when(F.col("query") == "de", F.regexp_replace("href", "example", "elsewhere")).otherwise(F.col("href"))
    return search.search(queries, lambda asked: hits.where("query <> 'fr'").withColumn("href", far).join(asked, "query", "left_semi"), max_results=3, allowed=ALLOWED)


_TITLES = ["Category:X - Wikimedia Commons", "Wikimedia", "Category:X", "plain"]


@query(f"select o_orderkey, {turn_sql([True, False, False, False], 'o_orderkey')} as category, {turn_sql([True, False, True], 'o_orderkey')} as blank from orders")
def result_filters(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _TITLES)), (n % 4 + 1).cast("int")).alias("title"), F.element_at(F.array(F.lit(""), F.lit("http://a.org/"), F.lit("  ")), (n % 3 + 1).cast("int")).alias("href"))
    kept = fusion.candidates(rows).select("o_orderkey", F.lit(False).alias("_kept"))
    return rows.join(kept, "o_orderkey", "left").select("o_orderkey", fusion.wikimedia_category(F.col("title")).alias("category"), F.coalesce("_kept", F.lit(True)).alias("blank"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'Search cancelled.' when 1 then 'Search failed: the search engines (a, b) did not respond within ' || (o_orderkey % 9 + 1) || ' seconds.' when 2 then 'Search failed: the search engines did not respond within ' || (o_orderkey % 9 + 1) || ' seconds.'
when 3 then 'No results found.' else 'Search failed: boom' end as text from orders""")
def search_failures(spark, sf_dir):
    n = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ["cancelled", "timeout", "timeout", "empty", "error"])), (n % 5 + 1).cast("int"))
    providers = F.when(n % 5 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fusion.search_failure(kind, providers, (n % 9 + 1) * 1000 + 400, F.lit("boom")).alias("text"))


@query("select * from (values ('2024-03-01T00:00:00.250Z', 'q', 5, 250::bigint, ['a', 'b'], 3)) v(ts, query, \"maxResults\", \"durationMs\", \"timedOutProviders\", \"resultCount\"), (select n_nationkey from nation)")
def sweep_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("q").alias("query"), F.lit(5).alias("max_results"), F.lit(1_709_251_200_000).alias("started_ms"), F.lit(1_709_251_200_250).alias("ended_ms"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("timed_out"), F.lit(3).alias("results"))
    return fusion.sweep_stats(rows).crossJoin(table(spark, sf_dir, "nation").select("n_nationkey")).distinct()  # 25 rows


# Evaluation.

_LABELS = [("en", "example.net"), ("en", "example.org"), ("fr", "example.com"), ("de", "example.org"), ("es", "example.com"), ("es", "no.example")]
_GOLD = "(values ('en', ['example.net', 'example.org']), ('fr', ['example.com']), ('de', ['example.org']), ('es', ['example.com', 'no.example'])) g(query, expected)"
_HIT = "len(list_filter(expected, lambda e: domain = e or domain like '%.' || e)) > 0"


def _golden(spark) -> DataFrame:
    return spark.createDataFrame(_LABELS, "query string, expected string")


def _runs(spark, sf_dir) -> DataFrame:
    """Each engine's first ten hits of a query."""
    return fusion.candidates(_hits(spark, sf_dir)).where("rank <= 10").withColumn("domain", U.registrable_domain(F.col("canon")))


_RUNS = f"runs as (select query, engine, ord, rank, canon, {domain_sql(part_sql('canon', 2))} as domain from hits where rank <= 10)"


@query(f"""with {_HITS_SQL}, {_RUNS}, p as (select engine, query, avg(case when {_HIT} then 1 else 0 end) as p from runs left join {_GOLD} using (query) where rank <= 5 group by engine, query)
select engine, round(sum(p) / (select count(distinct query) from hits), 9) as precision from p group by engine""")
def eval_precision(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return evaluate.precision(runs.where("rank <= 5"), _golden(spark), runs, ["engine"])


@query("select event_type, list_sort(list(value))[count(value) // 2 + 1] as median from events group by event_type")
def eval_median_ms(spark, sf_dir):
    return evaluate.upper_median(table(spark, sf_dir, "events"), "event_type", "value")


@query("select event_type as engine, count(*) filter (value < 10 or event_id % 7 = 0) as failures, count(*) as runs from events group by event_type")
def eval_failures(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.when(F.col("event_id") % 7 == 0, F.lit("timed out")).otherwise(F.lit("")).alias("error"), F.when(F.col("value") < 10, 0).otherwise(5).alias("results"))
    return evaluate.failures(runs)


@query(f"""with {_HITS_SQL}, {_RUNS}, e as (select distinct query, engine, canon from runs), s as (select query, engine, count(*) as n from e group by all),
b as (select x.query, x.engine as a, y.engine as b, count(*) as common from e x join e y on x.query = y.query and x.canon = y.canon group by all)
select p.engine as a, q.engine as b, round(avg(coalesce(common, 0) / (p.n + q.n - coalesce(common, 0))), 9) as jaccard from s p join s q on p.query = q.query and p.engine <> q.engine
left join b on b.query = p.query and b.a = p.engine and b.b = q.engine group by all""")
def eval_jaccard(spark, sf_dir):
    return evaluate.jaccard(_runs(spark, sf_dir))


@query(f"""with {_HITS_SQL}, {_RUNS}, r as (select runs.*, expected, not exists (select 1 from runs o where o.query = runs.query and o.canon = runs.canon and o.engine <> runs.engine) as own from runs left join {_GOLD} using (query))
select engine, count(*) as total, count(*) filter (own) as unique_urls, count(*) filter (own and {_HIT}) as unique_expected from r group by engine""")
def eval_unique(spark, sf_dir):
    return evaluate.unique_contribution(_runs(spark, sf_dir), _golden(spark))


_VECTORS = "('uniform', 'duckduckgo', 1.0), ('uniform', 'yandex', 1.0), ('uniform', 'startpage', 1.0), ('startpage-heavy', 'startpage', 2.0), ('startpage-heavy', 'duckduckgo', 1.5), ('startpage-heavy', 'yandex', 0.75), ('duckduckgo-heavy', 'duckduckgo', 2.0), ('duckduckgo-heavy', 'startpage', 1.5), ('duckduckgo-heavy', 'yandex', 0.75), ('yandex-heavy', 'yandex', 2.0), ('yandex-heavy', 'startpage', 1.5), ('yandex-heavy', 'duckduckgo', 1.5)"
_TOP = f"""w(vector, engine, w) as (values {_VECTORS}), s as (select vector, query, canon, round(sum(w / (60 + rank)), 12) as score, {domain_sql(part_sql("canon", 2))} as domain from f join w using (engine) group by all),
c as (select * from s, (values (0), (1), (2), (4), (5)) v(cap)), k as (select *, row_number() over (partition by vector, cap, query, domain order by score desc, canon) as n from c),
t as (select * from (select *, row_number() over (partition by vector, cap, query order by score desc, canon) as place from k where cap = 0 or n <= cap) where place <= 5)"""


def _grid(spark, sf_dir):
    caps = spark.createDataFrame([(c,) for c in evaluate.PER_HOST_CHOICES], "cap int")
    return fusion.candidates(_hits(spark, sf_dir)), evaluate.weights(spark), caps


@query(f"""with {_HITS_SQL}, {_TOP}, p as (select vector, cap, query, avg(case when {_HIT} then 1 else 0 end) as p from t left join {_GOLD} using (query) group by all),
d as (select vector, cap, query, count(distinct domain) as d from t group by all)
select vector, cap, (select round(sum(p) / (select count(distinct query) from hits), 9) from p where p.vector = d.vector and p.cap = d.cap) as precision, round(avg(d), 9) as domains from d group by vector, cap""")
def eval_grid(spark, sf_dir):
    return evaluate.grid(*_grid(spark, sf_dir), _golden(spark))


@query(f"""with {_HITS_SQL}, {_TOP}, o as (select query, canon, arg_min(engine, ord) as engine from hits group by all) select vector, cap, engine, count(*) as n from t join o using (query, canon) group by all""")
def eval_engine_mix(spark, sf_dir):
    cand, weight, caps = _grid(spark, sf_dir)
    return evaluate.engine_mix(evaluate.grid_top(cand, weight, caps), cand)


# Result pages.

_ITEMS = {
    "duckduckgo": "<div class='links result body'><h2 class=t><a href='/x'>{t}</a></h2><a class=s href='{u}'>{b}</a></div>",
    "yandex": "<li class='serp-item x'><h3><a href='{u}'>{t}</a></h3><div class='org-text'>{b}</div></li>",
    "startpage": "<div class='result css-1'><a href='{u}'><h2>{t}</h2></a><p>{b}</p></div>",
    "yahoo": "<li><div><a href='{u}'><h3 class='title'>{t}</h3></a></div><div class='compText x'>{b}</div></li>",
    "brave": "<div class='result-wrapper'><a href='{u}'><div class='title y'>{t}</div></a><div class='generic-snippet'>{b}</div></div>",
}


@query("""select s_nationkey || '/' || (s_suppkey // 50) as query, e.engine, row_number() over (partition by s_nationkey, s_suppkey // 50, e.engine order by s_suppkey)::int as rank, 'T & ' || s_name as title, 'https://s.example/a+b/' || s_suppkey as href, 'about ' || s_name || ' and more' as body
from supplier, (values ('duckduckgo'), ('yandex'), ('startpage'), ('yahoo'), ('brave')) e(engine)""")
def serp_extract(spark, sf_dir):
    """Pages of each engine for every nation, with its suppliers as results, up to fifty a page."""
    block = lambda t: F.concat(*[{"t": F.concat(F.lit("T &amp;\n "), F.col("s_name")), "u": F.concat(F.lit("https://s.example/a%20b/"), F.col("s_suppkey")), "b": F.concat(F.lit("about <b>"), F.col("s_name"), F.lit("</b>  and more"))}[p] if k % 2 else F.lit(p) for k, p in enumerate(_parts(t))])
    each = table(spark, sf_dir, "supplier").select(F.concat("s_nationkey", F.lit("/"), F.floor(F.col("s_suppkey") / 50)).alias("query"), "s_suppkey", F.explode(F.create_map(*[x for e, t in _ITEMS.items() for x in (F.lit(e), block(t))])).alias("engine", "block"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "block"))), lambda x: x["block"]), "")
    return serp.serp_hits(each.groupBy("query", "engine").agg(F.concat(F.lit("<html><body>"), listed, F.lit("</body>")).alias("html")))


def _parts(template: str) -> list[str]:
    """Plain pieces and field names of a template, in turn."""
    return [x for piece in template.split("{") for x in ([piece] if "}" not in piece else [piece.split("}")[0], piece.split("}")[1]])]


@query("select page_id, (generate_subscripts(hs, 1) - 1)::int as pos, unnest(hs) as href from (select page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) as hs from pages)")
def link_extract(spark, sf_dir):
    return serp.links(table(spark, sf_dir, "pages"))


@query(f"select n_nationkey, {literal('duckduckgo,startpage')} as plain, {literal('yandex,brave')} as rendering, {literal('duckduckgo,startpage')} as unknown from nation")
def engine_selection(spark, sf_dir):
    chosen = {"plain": serp.selected(), "rendering": serp.selected([" Brave", "YANDEX", "x"], rendering=True), "unknown": serp.selected(["yahoo", "x"])}
    return table(spark, sf_dir, "nation").select("n_nationkey", *[F.lit(",".join(names)).alias(k) for k, names in chosen.items()])


# The cache.

_NOW = 200 * 60_000
_CACHE_SQL = f"cache as (select sha256({CANON}) as key, page_id * 60000 as ts_ms, strlen(html)::bigint as size from pages)"


def _cache(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(U.cache_key(F.col("url")).alias("key"), (F.col("page_id") * 60_000).alias("ts_ms"), F.octet_length("html").cast("long").alias("size"))


@query(f"with {_CACHE_SQL} select key, ts_ms, size from (select *, row_number() over (order by ts_ms desc, key) as n, sum(size) over (order by ts_ms desc, key rows unbounded preceding) as t from cache where {_NOW} - ts_ms < 86400000) where n <= 128 and t <= 400000")
def cache_prune(spark, sf_dir):
    return cache.prune(_cache(spark, sf_dir), _NOW, size=400_000)


@query(f"with {_CACHE_SQL} select count(*) as entries, sum(size)::bigint as bytes from cache")
def cache_totals(spark, sf_dir):
    return cache.totals(_cache(spark, sf_dir))


@query(f"with {_CACHE_SQL} select key, {_NOW} - ts_ms < 3600000 as fresh, case when {_NOW} - ts_ms < 3600000 then chr(10) || chr(10) || '*Served from cache — network fetch failed*' else chr(10) || chr(10) || '*STALE cache from ' || strftime(epoch_ms(ts_ms), '%Y-%m-%d') || ' — network fetch failed, serving cached copy*' end as notice from cache")
def cache_fresh(spark, sf_dir):
    return _cache(spark, sf_dir).select("key", cache.is_fresh(F.col("ts_ms"), _NOW).alias("fresh"), cache.notice(F.col("ts_ms"), _NOW).alias("notice"))


@query(f"with {_CACHE_SQL} select key, max(ts_ms) as ts_ms, max_by(size, ts_ms) as size from (select * from cache union all select key, ts_ms + 1, size + 1 from cache where ts_ms % 120000 = 0) group by key")
def cache_upsert(spark, sf_dir):
    old = _cache(spark, sf_dir)
    return cache.upsert(old, old.where("ts_ms % 120000 = 0").select("key", (F.col("ts_ms") + 1).alias("ts_ms"), (F.col("size") + 1).alias("size")))


_C = canon_sql("url")


@query(f"""with c as (select canon, body, ts_ms from (select {_C} as canon, html as body, page_id * 60000 as ts_ms, row_number() over (partition by {_C} order by page_id desc) as n from pages where page_id % 2 = 0) where n = 1)
select page_id, c.body as cached_body, c.ts_ms as cached_ms, {_NOW} - c.ts_ms < 3600000 as fresh from pages p left join c on {canon_sql("p.url")} = c.canon""")
def cache_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    entries = pages.where("page_id % 2 = 0").select(U.cache_key(F.col("url")).alias("key"), F.col("html").alias("body"), F.lit("text/html").alias("content_type"), (F.col("page_id") * 60_000).alias("ts_ms"), F.lit(0).cast("long").alias("size"))
    kept = cache.upsert(entries.limit(0), entries)
    return cache.lookup(pages.select("page_id", "url"), kept, _NOW).select("page_id", "cached_body", "cached_ms", "fresh")


@query("select o_orderkey from orders where o_orderkey % 3 = 0 and o_orderkey % 5 > 0")
def cache_leftovers(spark, sf_dir):
    n = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/c/"), n, F.when(n % 3 == 0, F.lit(".json.tmp.1.2")).otherwise(F.lit(".json"))).alias("path"), F.timestamp_millis(F.lit(_NOW) - F.when(n % 5 == 0, F.lit(3_599_999)).otherwise(F.lit(3_600_000))).alias("modificationTime"))
    return cache.leftover_files(files, _NOW).select("o_orderkey")
