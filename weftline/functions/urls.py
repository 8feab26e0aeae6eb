"""URL algebra as Column functions: canonical form, registrable domain, policy and address tests.

A URL is read once, into a struct of its parts. Those that are in normal form already (which a pattern tells) are
read by built-in functions; only the others go through the URL Standard's reader in Python.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from weftline.functions import whatwg
from weftline.functions.hosts import plain_domain
from weftline.functions.text import SPACE, SPACES

# Two-label public suffixes, GitHub's reserved first segments, networks that are not public.
TRACKING = whatwg.TRACKING
SUFFIXES = ["co.uk", "org.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in"]
GITHUB_RESERVED = ["about", "apps", "codespaces", "collections", "contact", "customer-stories", "dashboard", "discussions", "enterprise", "explore", "features", "issues", "join", "login", "marketplace", "new", "notifications", "organizations", "orgs", "pricing", "pulls", "search", "security", "settings", "signup", "site", "sponsors", "team", "topics", "trending"]
NON_PUBLIC_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3)]
# Why a URL is refused.
EMPTY, BAD_CHARS = "Blocked: the URL is empty.", "Blocked: the URL contains invalid characters."
BAD_HOST, BAD_SCHEME = "Blocked: the URL has an invalid hostname or port.", "Blocked: only http/https URLs are allowed."
CREDENTIALS = "Blocked: URLs with credentials or encoded hostnames are not allowed."
BY_POLICY = "Blocked: the website access policy disallows "

PARTS = StructType([StructField(n, StringType()) for n in ("href", "scheme", "host", "domain", "path")] + [StructField("credentials", BooleanType())])
_LABEL = "[a-z](?:[a-z0-9-]{0,61}[a-z0-9])?"
_SIMPLE = rf"^https?://(?:{_LABEL}\.)+[a-z]+(?:/[A-Za-z0-9._~!$&()*+,;=:@%-]*)*(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?(?:#[!-~]*)?$"
_DOTS = r"/(?:\.|%2[eE]){1,2}(?:[/?#]|$)"
_TRACKED = rf"(?i)[?&](?:utm_[^=&#]*|{'|'.join(TRACKING)})(?:[=&#]|$)"


@F.arrow_udf(PARTS)
def _read_parts(url: pa.Array) -> pa.Array:
    out = []
    for u in url.to_pylist():
        found = None if u is None else whatwg.parts(u)
        out.append(found and {"href": found[0], "scheme": found[1], "host": found[2], "domain": plain_domain(found[2]), "path": found[4], "credentials": found[3]})
    return pa.array(out, pa.struct([(n, pa.string()) for n in PARTS.names[:-1]] + [("credentials", pa.bool_())]))


def url_parts(url: Column) -> Column:
    """Struct (href: canonical, scheme, host, domain: the host as policies compare it or null, path, credentials) of an absolute URL, or null."""
    return _read_parts(url)


def _simple(url: Column) -> Column:
    """Whether a URL is in normal form, but for its fragment and a missing path."""
    return F.coalesce(url.rlike(_SIMPLE) & ~url.rlike(_DOTS) & ~url.rlike(_TRACKED) & ~url.contains("xn--"), F.lit(False))


def canonicalize(url: Column) -> Column:
    """Without tracking keys, fragment and default port, written as browsers do. What they can't read stays as it is."""
    simple = _simple(url)
    own = F.regexp_replace(F.substring_index(url, "#", 1), r"^(https?://[^/?]+)($|\?)", "$1/$2")
    return F.when(simple | (url == ""), own).otherwise(F.coalesce(_read_parts(F.when(~simple, url))["href"], url))


def host(url: Column) -> Column:
    """Host in lower case; empty if the URL can't be read."""
    simple = _simple(url)
    return F.when(simple, F.regexp_extract(url, "^https?://([^/?#]+)", 1)).when(url.isNotNull(), F.coalesce(_read_parts(F.when(~simple, url))["host"], F.lit("")))


def domain_of_host(name: Column) -> Column:
    """The last two labels of a host, or three under the suffixes of two."""
    bare = F.regexp_replace(name, r"^www\.", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def registrable_domain(url: Column) -> Column:
    return domain_of_host(host(url))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize_scheme(url: Column) -> Column:
    """``https://`` before a bare dotted host with a valid port, ``//`` or not; all else unchanged but for blanks around it."""
    dotted = r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"
    own = trimmed(url)
    bare = F.regexp_replace(own, "^//", "")
    authority = F.regexp_extract(bare, "^[^/?#]*", 0)
    port = F.regexp_extract(authority, "^[^:]*:(.*)$", 1)
    fine = (port == "") | (port.rlike("^[0-9]{1,5}$") & port.try_cast("int").between(1, 65535))
    scheme = F.regexp_extract(own, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    other = (scheme != "") & (F.startswith(F.substring(own, F.char_length(scheme) + 2, F.lit(2)), F.lit("//")) | ~scheme.rlike(dotted))
    return F.when(~other & ~own.rlike("^/(?!/)") & F.substring_index(authority, ":", 1).rlike(dotted) & fine, F.concat(F.lit("https://"), bare)).otherwise(own)


def normalize_url(url: Column) -> Column:
    """Percent-decoded (malformed: unchanged), blanks to plus signs."""
    return F.replace(F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url), F.lit(" "), F.lit("+"))


_PERCENT = re.compile(r"%(?![0-9A-Fa-f]{2})")


def normal_url(url: str) -> str:
    """``normalize_url`` of a string."""
    try:
        decoded = url if _PERCENT.search(url) else whatwg.unescape(url).decode("utf-8")
    except UnicodeDecodeError:
        decoded = url
    return decoded.replace(" ", "+")


def cache_key(url: Column) -> Column:
    return F.sha2(canonicalize(url), 256)


def search_url(base: Column, params: dict[str, Column]) -> Column:
    pairs = [F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in params.items()]
    return F.concat(base, F.lit("?"), F.concat_ws("&", *pairs))


def in_domains(name: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith("." + d)
    return out


def policy_allows(name: Column, allowed: list[str], blocked: list[str], most: int = 100) -> Column:
    """Block beats allow, an empty allow list allows all, an oversized policy allows nothing."""
    if max(len(allowed), len(blocked)) > most:
        return F.lit(False)
    return ~in_domains(name, blocked) & (in_domains(name, allowed) if allowed else F.lit(True))


def with_suffixes(rows: DataFrame, url: str, suffix: str = "suffix") -> DataFrame:
    """Each row once for every domain suffix of its URL's host, for equi-joins with large policies."""
    named = rows.withColumn("_host", host(F.col(url)))
    each = named.select("*", F.posexplode(F.split("_host", r"\.")).alias("_at", "_label"))
    return each.withColumn(suffix, F.expr("substring_index(_host, '.', _at - size(split(_host, '[.]')))")).drop("_host", "_at", "_label")


ACCESS = StructType([StructField("reason", StringType()), StructField("domain", StringType())])
_BAD = re.compile(rf"[\x00-\x1f\\]|{SPACE}")


def refusal(url: str | None) -> tuple[str | None, str | None]:
    """(why a URL is refused whatever the policy, or None; its host as policies compare it)."""
    own = (url or "").strip(SPACES)
    if not own:
        return EMPTY, None
    if _BAD.search(own):
        return BAD_CHARS, None
    found = whatwg.parts(own)
    if found is None:
        return BAD_HOST, None
    _, scheme, name, credentials, _ = found
    if scheme not in ("http", "https"):
        return BAD_SCHEME, None
    if credentials or "%" in name:
        return CREDENTIALS, None
    domain = plain_domain(name)
    return (None, domain) if domain else (BAD_HOST, None)


@F.arrow_udf(ACCESS)
def _refused(url: pa.Array) -> pa.Array:
    return pa.array([dict(zip(ACCESS.names, refusal(u))) for u in url.to_pylist()], pa.struct([(n, pa.string()) for n in ACCESS.names]))


def check_access(url: Column, allowed: list[str] | None = None, blocked: list[str] | None = None, valid: bool = True) -> Column:
    """Struct (allowed, reason, host); the first failing check gives the reason. ``valid``: whether the policy is; one that isn't lets nothing through."""
    judged = _refused(url)
    fits = policy_allows(judged["domain"], allowed or [], blocked or []) if valid else F.lit(False)
    reason = F.coalesce(judged["reason"], F.when(~fits, F.concat(F.lit(BY_POLICY), judged["domain"], F.lit("."))), F.lit(""))
    return F.struct((reason == "").alias("allowed"), reason.alias("reason"), F.coalesce(judged["domain"], F.lit("")).alias("host"))


def is_literal(name: Column) -> Column:
    """Whether a host is an address."""
    return name.contains(":") | name.rlike(r"^\d+\.\d+\.\d+\.\d+$")


def engine_target_allowed(url: Column, allowed: list[str] | None = None, blocked: list[str] | None = None) -> Column:
    """Access, and a public address if the host is one."""
    from weftline.functions.hosts import is_public_ip

    access = check_access(url, allowed, blocked)
    return access["allowed"] & (~is_literal(access["host"]) | is_public_ip(access["host"]))


def scope_query(query: Column, domains: list[str], most: int = 8) -> Column:
    """``query (site:a OR site:b)``; of more than ``most`` domains a window chosen by a hash of the query (of the first UTF-16 unit of each character)."""
    if not domains:
        return query
    n = len(domains)
    sites = F.array(*[F.lit(f"site:{d}") for d in domains])
    if n > most:
        unit = lambda c: F.when(F.ascii(c) > 0xFFFF, F.lit(0xD800) + F.floor((F.ascii(c) - 0x10000) / 1024)).otherwise(F.ascii(c))
        start = F.aggregate(F.split(query, ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + unit(c)) % (1 << 32)) % n
        sites = F.slice(F.concat(sites, sites), (start + 1).cast("int"), most)
    return F.concat(query, F.lit(" ("), F.array_join(sites, " OR "), F.lit(")"))


def _github(url: Column) -> tuple[Column, Column, Column, Column]:
    """(is a repository's page, owner, repository, what follows) of a URL."""
    parts = url_parts(url)
    steps = F.filter(F.split(parts["path"], "/"), lambda s: s != "")
    owner, repo = F.get(steps, F.lit(0)), F.regexp_replace(F.get(steps, F.lit(1)), r"\.git$", "")
    name = r"^[A-Za-z0-9_.\-]{1,100}$"
    fits = parts["host"].isin("github.com", "www.github.com") & (F.size(steps) >= 2) & ~F.lower(owner).isin(GITHUB_RESERVED) & owner.rlike(name) & repo.rlike(name)
    return F.coalesce(fits, F.lit(False)), owner, repo, F.slice(steps, 3, 1 << 20)


def github_raw(url: Column) -> Column:
    """Raw-content URL of a GitHub blob or raw URL, or null."""
    fits, owner, repo, rest = _github(url)
    fits = fits & (F.size(rest) > 2) & F.get(rest, F.lit(0)).isin("blob", "raw")
    return F.when(fits, F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), owner, repo, F.array_join(F.slice(rest, 2, 1 << 20), "/")))


def github_readme_api(url: Column) -> Column:
    """The README's API URL of a repository's root, or null."""
    fits, owner, repo, rest = _github(url)
    return F.when(fits & (F.size(rest) == 0), F.concat_ws("/", F.lit("https://api.github.com/repos"), owner, repo, F.lit("readme")))


def github_readme_raw(url: Column) -> Column:
    """The README's raw URL of a repository's root, or null."""
    fits, owner, repo, rest = _github(url)
    return F.when(fits & (F.size(rest) == 0), F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), owner, repo, F.lit("HEAD/README.md")))


def local_path(url: Column, home: str = "/root") -> Column:
    """The path of a local file that ``url`` names (empty for a file URL that names none), or null."""
    own = trimmed(url)
    file_path = F.regexp_extract(own, r"(?i)^file:(?:///|//localhost/|/(?!/))([^?#]*)", 1)
    decoded = F.try_url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    named = F.when(own.rlike(r"(?i)^file:(?:///|//localhost/|/(?!/))") & ~file_path.rlike("(?i)%2f"), F.coalesce(F.concat(F.lit("/"), decoded), F.lit(""))).otherwise(F.lit(""))
    return (
        F.when(own.rlike("(?i)^file:"), named)
        .when(own.rlike(r"^~[/\\]"), F.concat(F.lit(home.rstrip("/") + "/"), F.substring(own, 3, 1 << 20)))
        .when(own.rlike(r"^[a-zA-Z]:[\\/]") | own.startswith("/") | own.rlike(r"^\.{1,2}/"), own)
    )


def is_local_path(url: Column) -> Column:
    return local_path(url).isNotNull()


@F.arrow_udf(StringType())
def resolve_url(target: pa.Array, base: pa.Array) -> pa.Array:
    """``target`` seen from the page ``base``; null where there is no such URL."""
    return pa.array([None if t is None or b is None else whatwg.resolve(t, b) for t, b in zip(target.to_pylist(), base.to_pylist())], pa.string())


def ipv4_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    number = sum((F.get(octets, F.lit(i)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(octets, F.lit(0)).try_cast("bigint") * (1 << 24))
    return F.when(ip.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & F.forall(octets, lambda o: o.try_cast("int") <= 255), number)


def is_public_ipv4(ip: Column) -> Column:
    number, inside = ipv4_number(ip), F.lit(False)
    for net, bits in NON_PUBLIC_V4:
        a, b, c, d = map(int, net.split("."))
        low = (a << 24) + (b << 16) + (c << 8) + d
        inside = inside | number.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(number.isNotNull() & ~inside, F.lit(False))
