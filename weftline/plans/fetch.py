"""From captured responses to readable text: each rule a column, each step a join, one parse a page.

Responses are rows (url, status, content_type, body, and where known location, truncated and content_encoding). What
goes wrong is a text in ``error``, worded as readers see it; no row makes a job fail.
"""

from __future__ import annotations

import re
from http.client import responses

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.functions.hosts import is_public_ip, policy_domains
from weftline.functions.html_events import EMPTY, START, events
from weftline.functions.markdown import page_struct, readme_body, render_body, visible
from weftline.operators import cache as C
from weftline.sources.pdf_text import CUT_UNREADABLE, NO_TEXT, UNREADABLE, pdf_text

TEXT_CAP, PDF_CAP, REQUESTS = 512 << 10, 10 << 20, 5
REDIRECTS = [301, 302, 303, 307, 308]
# Wording of failures.
FAILED = "Failed to fetch URL: "
NO_LOCATION, BAD_LOCATION = FAILED + "the redirect is missing a Location header.", FAILED + "the redirect has an invalid Location."
TOO_MANY, CANCELLED, TIMED_OUT, UNREACHED = FAILED + "too many redirects.", FAILED + "cancelled.", FAILED + "timed out.", FAILED + "no transport could reach the target"
STATUS = {**{int(code): reason for code, reason in responses.items()}, 413: "Payload Too Large", 422: "Unprocessable Entity", 509: "Bandwidth Limit Exceeded"}
# Markers and limits of pages that stand in for others, and the notes of rendered ones.
INTERSTITIAL = ["just a moment", "attention required", "you have been blocked", "enable javascript and cookies to continue", "checking if the site connection is secure", "access denied", "please enable cookies", "cf-error-details"]
INTERSTITIAL_PROSE, IMPROVES = 4000, 1.5
RENDER_FAILED = ["Failed to render URL:", "Blocked:", "(page returned no readable text)"]
RENDERED_HEAD = r"(?m)^(?:URL: |Rendered via |Title: |Author: |Date: |Site: ).*$"
INCOMPLETE_NOTE = "\n\n*(JavaScript-rendered page; content may be incomplete)*"


def winning_attempt(hops: DataFrame) -> DataFrame:
    """Of the attempts of a hop (url, hop, attempt, status, ...) the first below 400, else the first."""
    order = Window.partitionBy("url", "hop").orderBy((F.col("status") >= 400).cast("int"), "attempt", "status")
    return hops.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def status_message(status: Column) -> Column:
    """What a reader is told of a failed status: its number and standard reason."""
    reasons = F.create_map(*[F.lit(x) for code, reason in STATUS.items() for x in (code, " " + reason if reason else "")])
    return F.concat(F.lit(FAILED + "HTTP "), status.cast("string"), F.coalesce(F.try_element_at(reasons, status.cast("int")), F.lit("")))


def triage(status: Column, location: Column) -> Column:
    """The failure that a status is, or null: for a redirect with a location and for all below 300."""
    follows = status.isin(REDIRECTS)
    return F.when(follows & (F.coalesce(location, F.lit("")) == ""), F.lit(NO_LOCATION)).when((status >= 300) & ~follows, status_message(status))


def fetch_failure(message: Column) -> Column:
    """An error's message as readers see it."""
    return F.when(message == "cancelled", F.lit(CANCELLED)).when(message == "timed out", F.lit(TIMED_OUT)).otherwise(F.concat(F.lit(FAILED), message))


def host_verdicts(resolved: DataFrame) -> DataFrame:
    """``resolved`` (host, ip, family, ord): one private address rejects a host (``reason`` names the first); the first IPv4 address is used, else the first."""
    judged = resolved.withColumn("_public", is_public_ip(F.col("ip")))
    bad = F.min_by(F.when(~F.col("_public"), F.col("ip")), F.when(~F.col("_public"), F.col("ord")))
    found = judged.groupBy("host").agg(F.bool_and("_public").alias("public"), F.min_by("ip", F.struct(F.col("family") != 4, F.col("ord"))).alias("ip"), bad.alias("_bad"))
    return found.withColumn("reason", F.when(~F.col("public"), F.concat(F.lit("Blocked: refusing to fetch the non-public address "), F.col("_bad"), F.lit(".")))).drop("_bad")


# Bodies.


@F.arrow_udf(StringType())
def meta_refresh(page: pa.Array) -> pa.Array:
    """The URL of a page's first refresh that names one, or null."""
    return pa.array([None if p is None else refresh_of(p) for p in page.to_pylist()], pa.string())


_REFRESH = re.compile(r";\s*url\s*=\s*(.+)", re.I)


def refresh_of(page: str) -> str | None:
    if "refresh" not in page.lower():
        return None
    for kind, name, attrs in events(page):
        if name == "meta" and kind in (START, EMPTY) and (attrs.get("http-equiv") or "").lower() == "refresh":
            m = _REFRESH.search(attrs.get("content") or "")
            url = m[1].strip() if m else ""
            if len(url) > 1 and url[0] == url[-1] and url[0] in "\"'":
                url = url[1:-1].strip()
            if url:
                return url
    return None


def with_access(rows: DataFrame, url: str, allowed: list[str] | None, blocked: list[str] | None) -> DataFrame:
    """``access`` of a column of URLs; a policy that isn't valid lets nothing through."""
    only, never = policy_domains(allowed), policy_domains(blocked)
    valid = only is not None and never is not None
    return rows.withColumn("access", U.check_access(F.col(url), only if valid else [], never if valid else [], valid))


def body_of(body: bytes | None, encoding: str | None, content_type: str | None, truncated: bool | None) -> dict[str, str | None]:
    """What a body says (``text``) or why it says nothing (``error``), and its ``kind``."""
    whole, broken = T.inflate(body, encoding)
    if whole is None:
        whole, broken = body or b"", False
    kind = T.type_of(content_type)
    pdf = kind == "application/pdf" or T.magic_in(whole) == T.PDF_MAGIC
    cap = PDF_CAP if pdf or "pdf" in (content_type or "").lower() else TEXT_CAP
    own, cut = whole[:cap], bool(truncated) or broken or len(whole) > cap
    failed = lambda why: {"error": why, "text": None, "kind": "application/pdf" if pdf else kind}
    if pdf:
        text = pdf_text(own)
        if text is None:
            return failed(CUT_UNREADABLE if cut else UNREADABLE)
        text = text or NO_TEXT
    elif not T.is_text_kind(kind):
        return failed(f"(non-text content: {kind or 'unknown type'}, {len(own)} bytes; not readable as text)")
    else:
        text = None if T.magic_in(own) else T.decode_bytes(own, T.codec_for(own, content_type))
        if text is not None and T.is_odd(text):
            second = T.declared_codec(content_type) in (None, "iso8859-1") and T.mostly_ascii(own)
            text = T.decode_bytes(own, "cp1252") if second else None
            text = None if text is not None and T.is_odd(text) else text
        if text is None:
            return failed(f"(binary content, {len(own)} bytes; not readable as text)")
    return {"error": None, "text": text + "\n\n" + T.CUT if cut else text, "kind": "application/pdf" if pdf else kind}


BODY = StructType([StructField(n, StringType()) for n in ("error", "text", "kind")])


@F.arrow_udf(BODY)
def _bodies(body: pa.Array, encoding: pa.Array, content_type: pa.Array, truncated: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (body, encoding, content_type, truncated)))
    return pa.array([body_of(*r) for r in rows], pa.struct([(n, pa.string()) for n in BODY.names]))


def read_bodies(raw: DataFrame) -> DataFrame:
    """``raw`` with ``error``, ``text`` (the body decoded, or a PDF's text) and ``kind`` (its content type) of responses below 300.

    Bodies are inflated, cut at their limit with a notice, and judged in this order: PDF, type, magic number, charset,
    and whether the text looks binary (then it is read once more as windows-1252, if nothing speaks against it). All of
    it is one function of a body's bytes, so that no test is repeated where a later step builds on it.
    """
    for name, default in (("truncated", F.lit(False)), ("content_encoding", F.lit(None).cast("string"))):
        if name not in raw.columns:
            raw = raw.withColumn(name, default)
    rows = raw.withColumn("_read", _bodies.asNondeterministic()("body", "content_encoding", "content_type", "truncated"))
    return rows.select(*[c for c in raw.columns if c not in BODY.names], "_read.*")


def follow(requests: DataFrame, captured: DataFrame, allowed: list[str] | None = None, blocked: list[str] | None = None) -> DataFrame:
    """``requests`` (url) through ``captured`` responses, one a URL asked for: (url, at, error, text, kind), ``at`` the last URL.

    Redirects and refreshes of pages are followed for five requests in all, each checked by the policy. One join a
    request, over rows without texts; a URL that no response was captured for could not be reached.
    """
    read = read_bodies(captured if "location" in captured.columns else captured.withColumn("location", F.lit(None).cast("string")))
    read = read.withColumn("error", F.coalesce(triage(F.col("status"), F.col("location")), F.when(F.col("status") < 300, F.col("error"))))
    page = (F.col("status") < 300) & F.col("error").isNull() & (F.contains(F.col("kind"), F.lit("html")) | T.looks_like_html(F.col("text")))
    goes = F.when(F.col("status").isin(REDIRECTS) & F.col("error").isNull(), F.col("location")).otherwise(meta_refresh(F.when(page, F.col("text"))))
    answers = read.withColumn("goes", goes)
    steps = answers.select(F.col("url").alias("_at"), F.col("error").alias("_error"), "goes", F.col("status").isin(REDIRECTS).alias("redirect"))
    rows = with_access(requests.select("url", U.normalize_scheme(F.col("url")).alias("at")).distinct(), "at", allowed, blocked)
    rows = rows.select("url", "at", F.when(~F.col("access.allowed"), F.col("access.reason")).alias("error"), (~F.col("access.allowed")).alias("done"))
    for _ in range(REQUESTS):
        met = rows.join(steps, (F.col("at") == F.col("_at")) & ~F.col("done"), "left")
        target = U.resolve_url(F.col("goes"), F.col("at"))
        met = met.withColumn("next", F.when(F.col("redirect") | (target != F.col("at")), target))
        met = with_access(met, "next", allowed, blocked)
        lost, bad = F.col("redirect").isNull(), F.col("redirect") & F.col("goes").isNotNull() & F.col("next").isNull()
        refused = F.col("next").isNotNull() & ~F.col("access.allowed")
        error = F.when(lost, F.lit(UNREACHED)).when(bad, F.lit(BAD_LOCATION)).when(refused, F.col("access.reason")).otherwise(F.col("_error"))
        rows = met.select(
            "url",
            F.when(~F.col("done") & F.col("next").isNotNull() & ~refused, F.col("next")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("done"), F.col("error")).otherwise(error).alias("error"),
            (F.col("done") | F.col("next").isNull() | refused).alias("done"),
        )
    ended = rows.withColumn("error", F.when(~F.col("done"), F.lit(TOO_MANY)).otherwise(F.col("error")))
    texts = answers.where("error is null").select(F.col("url").alias("at"), "text", "kind")
    return ended.join(texts, "at", "left").select("url", "at", "error", F.when(F.col("error").isNull(), F.col("text")).alias("text"), F.when(F.col("error").isNull(), F.col("kind")).otherwise(F.lit("")).alias("kind"))


def read_pages(raw: DataFrame, allowed: list[str] | None = None, blocked: list[str] | None = None, most: int | None = None) -> DataFrame:
    """``raw`` responses to url, error, title, author, date, site, description, text, hint.

    Checks go in this order: access, status, then the body; the text is whole unless ``most`` limits it.
    """
    rows = read_bodies(with_access(raw, "url", allowed, blocked))
    location = F.col("location") if "location" in raw.columns else F.lit("")
    error = F.when(~F.col("access.allowed"), F.col("access.reason")).otherwise(F.coalesce(triage(F.col("status"), location), F.col("error")))
    rows = rows.withColumn("error", error)
    html = F.col("error").isNull() & (F.contains(F.col("kind"), F.lit("html")) | T.looks_like_html(F.col("text")))
    rows = rows.withColumn("_html", html)
    rows = rows.withColumn("page", page_struct.asNondeterministic()(F.when(F.col("_html"), F.col("text"))))
    body = F.when(F.col("_html"), F.col("page.text")).otherwise(U.trimmed(F.col("text")))
    return rows.select(
        "url",
        "error",
        *[F.col(f"page.{c}").alias(c) for c in ("title", "author", "date", "site", "description")],
        F.when(F.col("error").isNull(), T.truncate_text(body, most)).alias("text"),
        F.when(F.col("error").isNull(), F.col("page.hint")).alias("hint"),
    )


def read_files(files: DataFrame, most: int | None = None) -> DataFrame:
    """Local files as ``binaryFile`` reads them (path, length, content) to (path, text)."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = files.select("path", F.col("path").alias("url"), F.lit(200).alias("status"), F.when(ext.isin(".htm", ".html", ".xht", ".xhtml"), F.lit("text/html")).otherwise(F.lit("")).alias("content_type"), F.col("content").alias("body"))
    read = read_bodies(rows)
    shown = F.when(F.col("kind") == "application/pdf", F.col("text")).otherwise(render_body(F.col("text"), F.col("kind")))
    return read.select("path", F.coalesce("error", T.truncate_text(shown, most)).alias("text"))


def scan_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    return read_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), most)


# Where a text may come from.


def first_success(attempts: DataFrame) -> DataFrame:
    """Of the sources tried for a URL (url, attempt, text, error) the first without an error; else the first error."""
    order = Window.partitionBy("url").orderBy(F.col("error").isNotNull().cast("int"), "attempt")
    return attempts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sources(urls: DataFrame) -> DataFrame:
    """(url, attempt, source, at): where a URL's text is looked for, in order: raw content, the README by API, the raw README, the page itself."""
    u = U.normalize_scheme(F.col("url"))
    tries = F.array(*[F.struct(F.lit(k).alias("attempt"), F.lit(name).alias("source"), at.alias("at")) for k, (name, at) in enumerate((("raw", U.github_raw(u)), ("api", U.github_readme_api(u)), ("readme", U.github_readme_raw(u)), ("page", u)), 1)])
    return urls.select("url", F.explode(F.filter(tries, lambda t: t["at"].isNotNull())).alias("t")).select("url", "t.*")


def with_sources(tried: DataFrame) -> DataFrame:
    """``tried`` (url, attempt, source, error, text, kind): the first source that gave a text, rendered; a README says where it is from."""
    readme = readme_body(F.when(F.col("error").isNull() & F.col("source").isin("api", "readme"), F.col("text")))
    body = F.when(F.col("error").isNull(), F.when(F.col("source").isin("raw", "page"), render_body(F.col("text"), F.col("kind"))).otherwise(readme))
    via = F.when(F.col("source") == "api", F.lit("API")).otherwise(F.lit("URL"))
    named = F.concat(F.lit("README of "), F.col("url"), F.lit(" (fetched via the GitHub "), F.when(F.col("source") == "readme", F.lit("raw ")).otherwise(F.lit("")), F.lit("README "), via, F.lit("):\n\n"), F.col("_body"))
    rows = tried.withColumn("_body", body)
    blank = F.col("source").isin("api", "readme") & (U.trimmed(F.col("_body")) == "")
    rows = rows.withColumn("error", F.when(blank, F.lit("empty README")).otherwise(F.col("error"))).withColumn("text", F.when(F.col("source").isin("api", "readme"), named).otherwise(F.col("_body")))
    best = first_success(rows.select("url", "attempt", "source", "error", "text"))
    last = rows.where("source = 'page'").select("url", F.col("error").alias("_page_error"))
    source = F.when(F.col("error").isNotNull(), F.lit("page")).otherwise(F.col("source"))
    return best.join(last, "url", "left").select("url", source.alias("source"), F.when(F.col("error").isNotNull(), F.coalesce("_page_error", "error")).alias("error"), "text")


def snapshot_of(available: Column) -> Column:
    """Struct (url, day) of the snapshot that an availability answer (JSON) names, or null."""
    at = lambda key: F.get_json_object(available, f"$.archived_snapshots.closest.{key}")
    stamp = F.coalesce(at("timestamp"), F.lit(""))
    day = F.when(stamp == "", F.lit("unknown date")).otherwise(F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)))
    return F.when((at("available") == "true") & (F.coalesce(at("url"), F.lit("")) != "") & (at("status") == "200"), F.struct(at("url").alias("url"), day.alias("day")))


def recover(outcomes: DataFrame, cached: DataFrame, now_ms: int, available: DataFrame | None = None, snapshots: DataFrame | None = None, allowed: list[str] | None = None, blocked: list[str] | None = None) -> DataFrame:
    """``outcomes`` (url, error, text) with failed ones made up for: by the cache, fresh or stale, and a 404 by a snapshot.

    ``available`` (url, body) are availability answers, ``snapshots`` (url, error, text, kind) what was fetched of those that they name.
    What the policy blocks stays blocked.
    """
    failed = F.col("error").isNotNull() & ~F.col("error").startswith("Blocked:")
    rows = C.lookup(outcomes, cached, now_ms)
    kept = F.concat(render_body(F.when(failed, F.col("cached_body")), F.col("cached_type")), C.notice(F.col("cached_ms"), now_ms))
    rows = rows.withColumn("_kept", F.when(failed, kept))
    if available is not None and snapshots is not None:
        named = available.select("url", snapshot_of(F.col("body")).alias("s")).where("s is not null").select(F.col("url"), F.col("s.url").alias("_at"), F.col("s.day").alias("_day"))
        named = with_access(named, "_at", allowed, blocked).where("access.allowed")
        named = named.where(~U.is_literal(F.col("access.host")) | is_public_ip(F.col("access.host"))).drop("access")
        taken = snapshots.where("error is null").select(F.col("url").alias("_at"), render_body(F.col("text"), F.col("kind")).alias("_old"))
        rows = rows.join(named.join(taken, "_at"), "url", "left")
        old = F.concat(F.lit("*Fetched from Wayback Machine snapshot ("), F.col("_day"), F.lit(") for "), F.col("url"), F.lit(":*\n\n"), F.col("_old"))
        rows = rows.withColumn("_old", F.when(failed & F.col("error").rlike(r"HTTP 404\b"), old))
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("string"))
    made = F.coalesce("_kept", "_old")
    source = F.when(F.col("_kept").isNotNull(), F.lit("cache")).when(F.col("_old").isNotNull(), F.lit("snapshot")).otherwise(F.lit("fetch"))
    return rows.select("url", F.when(made.isNull(), F.col("error")).alias("error"), F.coalesce(made, F.col("text")).alias("text"), source.alias("source"))


def was_forbidden(text: Column) -> Column:
    return text.rlike(r"(?m)^Failed to fetch URL: HTTP 403\b")


def render_failed(text: Column) -> Column:
    out = F.lit(False)
    for prefix in RENDER_FAILED:
        out = out | text.startswith(prefix)
    return out


def improves(rendered: Column, fetched: Column) -> Column:
    return visible(rendered) > visible(fetched) * IMPROVES


def interstitial(text: Column) -> Column:
    """Whether a text of few words, its head left out, holds a marker of pages that stand in for others."""
    prose = visible(F.regexp_replace(text, RENDERED_HEAD, ""))
    return (prose <= INTERSTITIAL_PROSE) & F.exists(F.array(*map(F.lit, INTERSTITIAL)), lambda m: F.contains(F.lower(text), m))


def escalate(fetched: DataFrame, rendered: DataFrame, renderer: str = "the local renderer") -> DataFrame:
    """``fetched`` (url, error, text, hint) and what a browser made of some (url, text).

    A forbidden page is taken as rendered; a thin one (with a hint) if the rendering shows half again as much, else it
    is noted that it may be incomplete. Renderings that failed or show an interstitial count as none.
    """
    shown = F.coalesce("error", "text", F.lit(""))
    rows = fetched.withColumn("_shown", shown).join(rendered.select("url", F.col("text").alias("_rendered")), "url", "left")
    forbidden = was_forbidden(F.col("_shown"))
    thin = F.col("hint").isNotNull() & ~forbidden
    fine = F.col("_rendered").isNotNull() & ~render_failed(F.col("_rendered")) & ~interstitial(F.col("_rendered"))
    take = F.coalesce(fine & (forbidden | (thin & improves(F.col("_rendered"), F.col("_shown")))), F.lit(False))
    note = F.when(forbidden, F.lit(f"Direct fetch failed with HTTP 403; rendered locally with {renderer} instead.")).otherwise(F.lit(f"Direct fetch returned little content; rendered locally with {renderer} instead."))
    text = F.when(take, F.concat(note, F.lit("\n\n"), F.col("_rendered"))).when(thin, F.concat(F.col("_shown"), F.lit(INCOMPLETE_NOTE))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("error", F.when(~take, F.col("error"))).drop("_shown", "_rendered")
