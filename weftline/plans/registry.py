"""What the catalogues share: the registered queries, their SQL, and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def turn(values: list[str], key: Column) -> Column:
    """One of a few texts by a row's number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def turn_sql(values: list, key: str) -> str:
    return f"[{', '.join(literal(v) for v in values)}][({key} % {len(values)} + 1)::int]"


def literal(v) -> str:
    return "null" if v is None else repr(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


#: The parts of the plain URLs of ``pages``: scheme, host, path, query with its mark.
_SPLIT = r"^([a-z]+)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def part_sql(u: str, group: int) -> str:
    return f"regexp_extract({u}, '{_SPLIT}', {group})"


_TRACKING = ["_hsenc", "_hsmi", "dclid", "fbclid", "gbraid", "gclid", "gclsrc", "igshid", "mc_cid", "mc_eid", "msclkid", "srsltid", "twclid", "wbraid", "yclid"]


def canon_sql(u: str) -> str:
    """Of plain URLs: without fragment, with a path; a query that loses tracking keys is written anew, with a mark after each key."""
    pairs, key = f"string_split(substr({part_sql(u, 4)}, 2), '&')", "lower(split_part(p, '=', 1))"
    kept = f"list_filter({pairs}, lambda p: not (starts_with({key}, 'utm_') or {key} in ({', '.join(literal(t) for t in _TRACKING)})))"
    anew = f"case when len({kept}) = 0 then '' else '?' || array_to_string(list_transform({kept}, lambda p: case when contains(p, '=') then p else p || '=' end), '&') end"
    query = f"case when {part_sql(u, 4)} = '' or len({kept}) = len({pairs}) then {part_sql(u, 4)} else {anew} end"
    return f"({part_sql(u, 1)} || '://' || {part_sql(u, 2)} || case when {part_sql(u, 3)} = '' then '/' else {part_sql(u, 3)} end || {query})"


def domain_sql(host: str) -> str:
    """Of a host: its last two labels, or three under these suffixes."""
    bare = f"regexp_replace({host}, '^www\\.', '')"
    two, three = (f"array_to_string(string_split({bare}, '.')[-{k}:], '.')" for k in (2, 3))
    return f"case when {two} in ('co.uk', 'org.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.in') then {three} else {two} end"


CANON, HOST = canon_sql("url"), part_sql("url", 2)
ALLOWED, BLOCKED = ["example.com", "example.net"], ["cheap-pills.example.com", "spam-farm.example.net"]


def in_sql(host: str, domains: list[str]) -> str:
    return "(" + " or ".join(f"{host} = '{d}' or {host} like '%.{d}'" for d in domains) + ")"
