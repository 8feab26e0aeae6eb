"""Host names and addresses in normal form: IDNA, IPv6 text and tests for public addresses."""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.whatwg import compress_groups, to_ascii

# What the compressed text of a non-public IPv6 address starts with (or is).
NON_PUBLIC_V6 = r"^(::|f[cd]|fe[89a-f][0-9a-f]:|ff|2001:db8|64:ff9b:|2001:10:|2002:|2001:0:|2001::|2001:2:|2001:1::[12]$)"
_LABELS = re.compile(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*")
_NUMBERS = re.compile(r"(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+)){0,3}")
_REFUSED = re.compile(r"[\x00-\x1f\\/@?#]")


def short_ipv6(text: str) -> str | None:
    """Compressed lower-case form; null for scoped, dotted and malformed text."""
    if "." in text or "%" in text:
        return None
    try:
        packed = ipaddress.IPv6Address(text).packed
    except ValueError:
        return None
    return compress_groups([int.from_bytes(packed[k : k + 2], "big") for k in range(0, 16, 2)])


def plain_domain(value: str | None) -> str | None:
    """A host as policies compare it, without brackets and closing dots; null if it can't be one."""
    name = (value or "").strip().lower()
    if not name or _REFUSED.search(name) or name.startswith("[") != name.endswith("]"):
        return None
    name = name.removeprefix("[").removesuffix("]").rstrip(".")
    if ":" in name:
        return short_ipv6(name)
    if _NUMBERS.fullmatch(name):
        try:
            return str(ipaddress.IPv4Address(name))
        except ValueError:
            return None
    name = to_ascii(name) or ""
    return name if len(name) <= 253 and _LABELS.fullmatch(name) else None


def policy_domains(domains: list[str] | None, most: int = 100) -> list[str] | None:
    """A policy's list in normal form, each domain once; null if it is too long or holds what can't be a domain."""
    given = domains or []
    found = [plain_domain(d) if isinstance(d, str) else None for d in given]
    return None if len(given) > most or None in found else list(dict.fromkeys(found))


def policy_prompt(allowed: list[str] | None, blocked: list[str] | None) -> str:
    """What a model is told of a policy; empty without limits. A policy that isn't valid raises ``ValueError``."""
    allowed, blocked = policy_domains(allowed), policy_domains(blocked)
    if allowed is None or blocked is None:
        raise ValueError("invalid website policy")
    # The wording of the prompt.
    lines = [
        "Website access limits are enforced by the application.",
        f"Only search or fetch these domains and their subdomains: {', '.join(allowed)}. Do not propose, cite, or attempt any other website." if allowed else "",
        f"Never search or fetch these domains or their subdomains: {', '.join(blocked)}." if blocked else "",
        "Blocked search results are unavailable; do not try to work around these limits.",
    ]
    return "\n".join(filter(None, lines)) if allowed or blocked else ""


def _each(values: pa.Array, f) -> pa.Array:
    return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def compress_ipv6(ip: pa.Array) -> pa.Array:
    return _each(ip, short_ipv6)


@F.arrow_udf(StringType())
def normalize_domain(name: pa.Array) -> pa.Array:
    return _each(name, plain_domain)


def strip_brackets(name: Column) -> Column:
    return F.regexp_replace(name, r"^\[(.*)\]$", "$1")


def is_public_ip(ip: Column) -> Column:
    """Of either family; anything that is not an address in plain text is not public."""
    from weftline.functions.urls import ipv4_number, is_public_ipv4

    short = compress_ipv6(ip)
    return F.when(ipv4_number(ip).isNotNull(), is_public_ipv4(ip)).otherwise(F.coalesce(~short.rlike(NON_PUBLIC_V6), F.lit(False)))
