"""Queries over URLs, hosts, policies and addresses, with their SQL. What the SQL expects is written out as literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import hosts as H
from weftline.functions import urls as U
from weftline.plans.registry import ALLOWED, BLOCKED, CANON, HOST, domain_sql, in_sql, literal, part_sql, query, table, turn, turn_sql

_BARE = f"{part_sql('url', 1)} || '://' || {part_sql('url', 2)} || {part_sql('url', 3)}"


@query(f"""select page_id, case page_id % 6 when 0 then {CANON} when 1 then {CANON} when 2 then {_BARE} || '?b=a+b&q=' when 3 then {_BARE} || '/z%20b/%C3%BC?x=%271' when 4 then 'no url ' || page_id else {_BARE} || '?q=' end as canon from pages""")
def url_canonical(spark, sf_dir):
    """URLs as they are, with capitals and default ports, tracking keys, dots, blanks and non-ASCII, and what is no URL."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    ported = F.concat(F.upper(F.substring_index("url", "://", 1)), F.lit("://"), F.upper(F.regexp_extract("url", "://([^/]+)", 1)), F.when(F.col("url").startswith("https"), F.lit(":443")).otherwise(F.lit(":80")), F.regexp_extract("url", "://[^/]+(.*)$", 1))
    kinds = [F.col("url"), ported, F.concat(bare, F.lit("?utm_source=x&b=a%20b&GCLID=1&q#top")), F.concat(bare, F.lit("/./a/%2E%2e/z b/\u00fc?x='1")), F.concat(F.lit("no url "), F.col("page_id")), F.concat(bare, F.lit("?q&fbclid=1"))]
    return table(spark, sf_dir, "pages").select("page_id", U.canonicalize(F.element_at(F.array(*kinds), (F.col("page_id") % 6 + 1).cast("int"))).alias("canon"))


@query(f"select page_id, case page_id % 4 when 0 then {domain_sql(HOST)} when 1 then 'x' || page_id || '.co.uk' when 2 then (page_id % 256) || '.7' else '' end as domain, case page_id % 4 when 0 then {HOST} when 1 then 'www.a.x' || page_id || '.co.uk' when 2 then '10.1.' || (page_id % 256) || '.7' else '' end as host from pages")
def registrable_domain(spark, sf_dir):
    n = F.col("page_id")
    kinds = F.array(F.col("url"), F.concat(F.lit("https://www.A.x"), n, F.lit(".co.uk/p")), F.concat(F.lit("http://10.1."), n % 256, F.lit(".7:80/")), F.concat(F.lit("page "), n))
    pages = table(spark, sf_dir, "pages").withColumn("u", F.element_at(kinds, (n % 4 + 1).cast("int")))
    return pages.select("page_id", U.registrable_domain(F.col("u")).alias("domain"), U.host(F.col("u")).alias("host"))


@query("""select page_id, case page_id % 6 when 0 then 'https://' || bare when 1 then 'https://' || bare when 2 then url when 3 then 'https://a.org:8443/' || page_id when 4 then 'a.org:99999/' || page_id else 'mailto:a@b.org' end as url
from (select page_id, url, regexp_replace(url, '^https?://', '') as bare from pages)""")
def url_normalize_scheme(spark, sf_dir):
    n, bare = F.col("page_id"), F.regexp_replace("url", "^https?://", "")
    kinds = F.array(bare, F.concat(F.lit(" //"), bare, F.lit("\t")), F.col("url"), F.concat(F.lit("a.org:8443/"), n), F.concat(F.lit("a.org:99999/"), n), F.lit("mailto:a@b.org"))
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_scheme(F.element_at(kinds, (n % 6 + 1).cast("int"))).alias("url"))


@query("select page_id, replace(url_decode(replace(url, '+', '%2B')), ' ', '+') || case page_id % 2 when 0 then '/a+b+c' else '%zz' end as url from pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.lit("/a%20b c")).otherwise(F.lit("%zz")))).alias("url"))


@query(f"select page_id, sha256({CANON}) as key from pages")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.cache_key(F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#x"))).alias("key"))


@query("select item_id, 'https://s.example/find?q=' || replace(url_encode(text), '%20', '+') || '&n=' || item_id as url from benchmark where regexp_full_match(text, '[A-Za-z0-9 ,.]*') and not contains(text, ',')")
def search_url(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where(F.col("text").rlike(r"^[A-Za-z0-9 ,.]*$") & ~F.col("text").contains(","))
    return items.select("item_id", U.search_url(F.lit("https://s.example/find"), {"q": F.col("text"), "n": F.col("item_id").cast("string")}).alias("url"))


_REFUSED = ["", " ", "http://a b.example.com/", "http://a.example.com\\x", "http://", "http://a.example.com:70000/", "ftp://a.example.com/", "http://u:p@a.example.com/", "http://-a.example.com/"]
_WHY = ["Blocked: the URL is empty.", "Blocked: the URL is empty.", "Blocked: the URL contains invalid characters.", "Blocked: the URL contains invalid characters.", "Blocked: the URL has an invalid hostname or port.", "Blocked: the URL has an invalid hostname or port.", "Blocked: only http/https URLs are allowed.", "Blocked: URLs with credentials or encoded hostnames are not allowed.", "Blocked: the URL has an invalid hostname or port."]
_FITS = f"(not {in_sql(HOST, BLOCKED)} and {in_sql(HOST, ALLOWED)})"


@query(f"""select page_id, {_FITS} and page_id % 3 > 0 as allowed, case when page_id % 3 = 0 then {turn_sql(_WHY, "(page_id // 3)")} when not {_FITS} then 'Blocked: the website access policy disallows ' || {HOST} || '.' else '' end as reason,
case when page_id % 3 = 0 then '' else {HOST} end as host from pages""")
def policy_check(spark, sf_dir):
    """URLs of all kinds that are refused, and pages under a policy."""
    n = F.col("page_id")
    url = F.when(n % 3 == 0, turn(_REFUSED, F.floor(n / 3))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.check_access(url, ALLOWED, BLOCKED).alias("v")).select("page_id", "v.*")


_TARGETS = ["https://a.org/", "https://8.8.8.8/x", "http://127.0.0.1/", "http://[::1]:80/", "http://[2606:4700::1]/", "http://0x7f.1/", "ftp://a.org/", "http://sub.b.org/"]


@query(f"select o_orderkey, {turn_sql([True, True, False, False, True, False, False, False], 'o_orderkey')} as allowed from orders")
def engine_target(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", U.engine_target_allowed(turn(_TARGETS, F.col("o_orderkey")), None, ["b.org"]).alias("allowed"))


@query(f"""select page_id, case when len(name) <= 253 and not regexp_full_match(name, '[0-9.]+') and regexp_full_match(name, '[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)*') then name end as domain
    from (select page_id, rtrim(lower(trim({HOST})), '.') as name from pages)""")
def domain_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.normalize_domain(F.concat(F.lit(" "), F.upper(U.host(F.col("url"))), F.lit(". "))).alias("domain"))


_NAMES = ["[2001:DB8:0:0::1]", "::1", "[::1", "0x7f.0.0.1", "2130706433", "8.8.8.8.", "M\u00fcnchen.de", "a_b.org", "x.org:80", "https://x.org", "-a.org", "UPPER.Org."]


@query(f"select o_orderkey, {turn_sql(['2001:db8::1', '::1', None, None, None, '8.8.8.8', 'xn--mnchen-3ya.de', None, None, None, None, 'upper.org'], 'o_orderkey')} as domain, {turn_sql(['2001:DB8:0:0::1', '::1', '[::1'] + _NAMES[3:], 'o_orderkey')} as bare from orders")
def domain_cases(spark, sf_dir):
    name = turn(_NAMES, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", H.normalize_domain(name).alias("domain"), H.strip_brackets(name).alias("bare"))


_V6 = "^(::|f[cd]|fe[89a-f][0-9a-f]:|ff|2001:db8|64:ff9b:|2001:10:|2002:|2001:0:|2001::|2001:2:|2001:1::[12]$)"


@query(f"""select o_orderkey, short, not regexp_matches(short, '{_V6}') as public
    from (select o_orderkey, {turn_sql(["2001:", "2002:", "2606:", "fe80:", "fd00:"], "o_orderkey")} || lower(hex(o_orderkey % 4096 + 1)) || '::' || lower(hex(o_orderkey % 65535 + 1)) as short from orders)""")
def ip_public_v6(spark, sf_dir):
    key = F.col("o_orderkey")
    ip = F.concat(turn(["2001:", "2002:", "2606:", "fe80:", "fd00:"], key), F.lpad(F.hex(key % 4096 + 1), 4, "0"), F.lit(":0:0:0:0:0:"), F.hex(key % 65535 + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", H.compress_ipv6(ip).alias("short"), H.is_public_ip(ip).alias("public"))


_IP = "concat_ws('.', o_orderkey % 256, (o_orderkey * 7) % 256, (o_orderkey * 13) % 256, (o_orderkey * 31) % 256)"
_O = ["(o_orderkey % 256)", "((o_orderkey * 7) % 256)", "((o_orderkey * 13) % 256)"]
_PRIVATE = f"""{_O[0]} in (0, 10, 127) or {_O[0]} >= 224 or {_O[0]} = 100 and {_O[1]} between 64 and 127 or {_O[0]} = 169 and {_O[1]} = 254 or {_O[0]} = 172 and {_O[1]} between 16 and 31
 or {_O[0]} = 192 and ({_O[1]} = 168 or {_O[1]} = 0 and {_O[2]} in (0, 2) or {_O[1]} = 88 and {_O[2]} = 99) or {_O[0]} = 198 and ({_O[1]} in (18, 19) or {_O[1]} = 51 and {_O[2]} = 100) or {_O[0]} = 203 and {_O[1]} = 0 and {_O[2]} = 113"""


@query(f"select o_orderkey, {_IP} as ip, not ({_PRIVATE}) as public from orders")
def ip_public_v4(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_IP).alias("ip")).withColumn("public", H.is_public_ip(F.col("ip")))


def _suffix_join(spark, sf_dir, domains, how):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    policy = spark.createDataFrame([(d,) for d in domains], "suffix string")
    hit = U.with_suffixes(pages, "url").join(F.broadcast(policy), "suffix").select("page_id").distinct()  # a policy is a parameter
    return pages.join(hit, "page_id", how)


@query(f"select page_id, url from pages where {in_sql(HOST, ALLOWED)}")
def policy_semi(spark, sf_dir):
    return _suffix_join(spark, sf_dir, ALLOWED, "left_semi")


@query(f"select page_id, url from pages where not {in_sql(HOST, BLOCKED)}")
def policy_anti(spark, sf_dir):
    return _suffix_join(spark, sf_dir, BLOCKED, "left_anti")


@query("select item_id, text || ' (site:example.com OR site:example.net)' as query from benchmark")
def scope_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", U.scope_query(F.col("text"), ALLOWED).alias("query"))


_TEN = [f"d{i}.example" for i in range(10)]


@query(f"""select o_orderkey, q || ' (' || array_to_string(list_transform(range(8), lambda k: 'site:d' || ((h + k) % 10) || '.example'), ' OR ') || ')' as query
from (select o_orderkey, q, list_reduce(list_prepend(0::bigint, list_transform(string_split(q, ''), lambda c: ord(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296) % 10 as h from (select o_orderkey, 'q' || o_orderkey as q from orders))""")
def scope_query_window(spark, sf_dir):
    """More domains than a query may name: a window of them, by the query's hash."""
    return table(spark, sf_dir, "orders").select("o_orderkey", U.scope_query(F.concat(F.lit("q"), F.col("o_orderkey")), _TEN).alias("query"))


_GH = "'https://raw.githubusercontent.com/o' || o_orderkey || '/r.x/HEAD/README.md'"


@query(f"""select o_orderkey, case o_orderkey % 6 when 2 then 'https://raw.githubusercontent.com/o' || o_orderkey || '/r/main/d/a.md' end as raw, case o_orderkey % 6 when 0 then 'https://api.github.com/repos/o' || o_orderkey || '/r.x/readme' when 1 then 'https://api.github.com/repos/o' || o_orderkey || '/r.x/readme' end as api,
case when o_orderkey % 6 in (0, 1) then {_GH} end as readme from orders""")
def github_rewrites(spark, sf_dir):
    n = F.col("o_orderkey")
    own = lambda *rest: F.concat(F.lit("https://github.com/o"), n, F.lit("".join(rest)))
    url = F.element_at(F.array(own("/r.x"), F.concat(F.lit("https://www.github.com/o"), n, F.lit("/r.x.git/?tab=1")), own("/r/blob/main/d/a.md"), F.lit("https://github.com/topics/x"), own("/r/issues/1"), F.lit("https://gitlab.com/a/b")), (n % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", U.github_raw(url).alias("raw"), U.github_readme_api(url).alias("api"), U.github_readme_raw(url).alias("readme"))


_PATHS = ["file:///a%20b+c/d.txt", "file://host/x", "~/notes.md", " /abs/x ", "./rel", "../up", "C:\\x\\y", "https://a.org/", "plain"]
_FOUND = ["/a b+c/d.txt", "", "/home/u/notes.md", "/abs/x", "./rel", "../up", "C:\\x\\y", None, None]


@query(f"select o_orderkey, {turn_sql(_FOUND, 'o_orderkey')} as path, {turn_sql([p is not None for p in _FOUND], 'o_orderkey')} as is_local from orders")
def local_paths(spark, sf_dir):
    url = turn(_PATHS, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", U.local_path(url, "/home/u").alias("path"), U.is_local_path(url).alias("is_local"))


_PROMPT = "Website access limits are enforced by the application.\nOnly search or fetch these domains and their subdomains: example.com, example.net. Do not propose, cite, or attempt any other website.\nNever search or fetch these domains or their subdomains: cheap-pills.example.com, spam-farm.example.net.\nBlocked search results are unavailable; do not try to work around these limits."


@query(f"select n_nationkey, {literal(_PROMPT)} as prompt from nation")
def policy_prompt(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lit(H.policy_prompt(ALLOWED, BLOCKED)).alias("prompt"))
