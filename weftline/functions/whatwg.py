"""URLs as browsers read and write them (the URL Standard), on plain strings."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field
from functools import lru_cache

try:
    import idna
except ImportError:  # the standard library's codec knows IDNA 2003 only
    idna = None

# Default ports of the special schemes, what each part of a URL escapes besides controls and non-ASCII, what no host holds.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
IN_FRAGMENT = ' "<>`'
IN_QUERY = ' "#<>'
IN_PATH = IN_QUERY + "?^`{}"
IN_USERINFO = IN_PATH + "/:;=@[\\]|"
NOT_IN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
TRACKING = ["_hsenc", "_hsmi", "dclid", "fbclid", "gbraid", "gclid", "gclsrc", "igshid", "mc_cid", "mc_eid", "msclkid", "srsltid", "twclid", "wbraid", "yclid"]

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
_ONE, _TWO = re.compile(r"\.|%2e", re.I), re.compile(r"(?:\.|%2e){2}", re.I)
_NUMBER = re.compile(r"0[xX][0-9A-Fa-f]*|[0-9]+")


def escape(text: str, these: str) -> str:
    """Percent-escapes controls, non-ASCII and ``these``; what is escaped already stays."""
    if text.isascii() and text.isprintable() and not any(c in these for c in text):
        return text
    return "".join(c if " " <= c <= "~" and c not in these else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace") if True) for c in text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def unescape(text: str) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))


def to_ascii(name: str) -> str | None:
    """A domain in ASCII and lower case, or None if it can't be."""
    if name.isascii():
        return name.lower()
    try:
        return (idna.encode(name, uts46=True) if idna else name.lower().encode("idna")).decode("ascii").lower()
    except UnicodeError:  # IDNAError is one
        return None


def compress_groups(groups: list[int]) -> str:
    """IPv6 text: the first of the longest runs of two or more zero groups is left out."""
    best, run = (0, 0), 0
    for k, g in enumerate([*groups, 1]):
        if g:
            best = max(best, (run, -(k - run)))
            run = 0
        else:
            run += 1
    length, start = best[0], -best[1]
    if length < 2:
        return ":".join(f"{g:x}" for g in groups)
    return ":".join(f"{g:x}" for g in groups[:start]) + "::" + ":".join(f"{g:x}" for g in groups[start + length :])


def _ipv4(host: str) -> str | None:
    """Dotted form of a host whose last label is a number, or None if it isn't an address."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    values = []
    for p in parts:
        if not _NUMBER.fullmatch(p):
            return None
        base = 16 if p[:2] in ("0x", "0X") else 8 if len(p) > 1 and p[0] == "0" else 10
        try:
            values.append(int(p[2:] or "0", 16) if base == 16 else int(p, base))
        except ValueError:
            return None
    if len(values) > 4 or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        return None
    number = values[-1] + sum(v << (24 - 8 * k) for k, v in enumerate(values[:-1]))
    return str(ipaddress.IPv4Address(number))


def parse_host(text: str) -> str | None:
    """Host of a special URL in normal form (IPv6 in brackets), or None."""
    if text.startswith("["):
        try:
            address = ipaddress.IPv6Address(text[1:-1]) if text.endswith("]") and "%" not in text else None
        except ValueError:
            address = None
        return address and "[" + compress_groups([int(g, 16) for g in address.exploded.split(":")] if "." not in address.exploded else [int.from_bytes(address.packed[k : k + 2], "big") for k in range(0, 16, 2)]) + "]"
    name = to_ascii(unescape(text).decode("utf-8", "replace"))
    if not name or NOT_IN_HOST.search(name):
        return None
    last = [p for p in name.removesuffix(".").split(".")][-1]
    return _ipv4(name) if last.isdigit() or _NUMBER.fullmatch(last) else name


@dataclass
class Url:
    scheme: str
    username: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: list[str] | str = field(default_factory=list)  # a string where it is opaque
    query: str | None = None
    fragment: str | None = None

    @property
    def special(self) -> bool:
        return self.scheme in PORTS

    @property
    def hostname(self) -> str:
        return self.host or ""

    def __str__(self) -> str:
        own = ""
        if self.host is not None:
            user = self.username + (":" + self.password if self.password else "")
            own = "//" + (user + "@" if user else "") + self.host + (f":{self.port}" if self.port is not None else "")
        path = self.path if isinstance(self.path, str) else "".join("/" + p for p in self.path)
        return self.scheme + ":" + own + path + ("" if self.query is None else "?" + self.query) + ("" if self.fragment is None else "#" + self.fragment)


def _segments(text: str, special: bool, start: list[str]) -> list[str]:
    """``start`` followed by a path's segments, dots resolved."""
    out = list(start)
    parts = (text.replace("\\", "/") if special else text).split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if _TWO.fullmatch(part):
            out = out[:-1]
            out += [""] if last else []
        elif _ONE.fullmatch(part):
            out += [""] if last else []
        else:
            out.append(escape(part, IN_PATH))
    return out


def _authority(url: Url, text: str) -> bool:
    user, at, place = text.rpartition("@")
    if at:
        name, _, word = user.partition(":")
        url.username, url.password = escape(name, IN_USERINFO), escape(word, IN_USERINFO)
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", place, re.S)
    if not m or (m[2] and not (m[2].isascii() and m[2].isdigit())) or (not m[1] and (url.special or at or m[2])):
        return False
    if m[2] and int(m[2]) > 65535:
        return False
    url.port = int(m[2]) if m[2] and int(m[2]) != PORTS.get(url.scheme, -1) else None
    if url.special or m[1].startswith("["):
        url.host = parse_host(m[1])
    else:
        url.host = None if re.search(r"[\x00\t\n\r #/:<>?@\[\\\]^|]", m[1]) else escape(m[1], "")
    return url.host is not None


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL that ``text`` is, by itself or seen from ``base``; None where browsers find none."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    text, hash_mark, fragment = text.partition("#")
    m = _SCHEME.match(text)
    scheme, rest = (m[0][:-1].lower(), text[m.end() :]) if m else ("", text)
    if not m and base is None:
        return None
    url = Url(scheme or base.scheme, fragment=escape(fragment, IN_FRAGMENT) if hash_mark else None)
    slashes = "/\\" if url.special else "/"
    rest, mark, query = rest.partition("?")
    if mark:
        url.query = escape(query, IN_QUERY + ("'" if url.special else ""))
    relative = not m or (base is not None and scheme == base.scheme and url.special and not isinstance(base.path, str))
    two = rest[:1] in slashes and rest[1:2] in slashes and len(rest) > 1
    if scheme == "file" or (not m and url.scheme == "file"):
        path = rest[2:] if two else rest
        host, _, tail = path.replace("\\", "/").partition("/") if two else ("", "", path.lstrip("/\\"))
        url.host = "" if host in ("", "localhost") else parse_host(host)
        url.path = _segments(tail, True, [])
        return None if url.host is None else url
    if m and url.special and (two or not relative):
        own = rest.lstrip(slashes)
    elif two and (not m or not url.special):
        own = rest[2:]
    elif m and not relative:
        if rest.startswith("/"):
            url.path = _segments(rest[1:], False, [])
        else:
            url.path = escape(rest, "").rstrip(" ") if url.query is None and not hash_mark else escape(rest, "")
        return url
    else:
        if isinstance(base.path, str):
            return None if rest or mark or not hash_mark else Url(base.scheme, path=base.path, query=base.query, fragment=url.fragment)
        url.username, url.password, url.host, url.port = base.username, base.password, base.host, base.port
        if not rest:
            url.path = list(base.path)
            url.query = url.query if mark else base.query
        elif rest[0] in slashes:
            url.path = _segments(rest[1:], url.special, [])
        else:
            url.path = _segments(rest, url.special, base.path[:-1])
        return url
    m = re.search("[/\\\\]" if url.special else "/", own)
    at = m.start() if m else len(own)
    if not _authority(url, own[:at]):
        return None
    url.path = _segments(own[at + 1 :], url.special, []) if at < len(own) else [""] if url.special else []
    return url


def pairs(query: str | None) -> list[tuple[str, str]]:
    """Names and values of a query as forms write them."""
    read = lambda t: unescape(t.replace("+", " ")).decode("utf-8", "replace")
    return [(read(k), read(v)) for k, _, v in (p.partition("=") for p in (query or "").split("&") if p)]


def form(values: list[tuple[str, str]]) -> str:
    write = lambda t: "".join("+" if b == 0x20 else chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "*-._") else f"%{b:02X}" for b in t.encode("utf-8", "replace"))
    return "&".join(f"{write(k)}={write(v)}" for k, v in values)


def is_tracking(name: str) -> bool:
    return name.lower().startswith("utm_") or name.lower() in TRACKING


def canonical_href(href: str) -> str:
    """Without tracking keys, fragment and default port; what browsers can't read stays as it is. A query that loses a key is written anew."""
    url = parse(href) if href else None
    if url is None:
        return href
    own = pairs(url.query)
    if any(is_tracking(k) for k, _ in own):
        url.query = form([p for p in own if not is_tracking(p[0])]) or None
    url.fragment = None
    return str(url)


def resolve(target: str, base: str) -> str | None:
    """``target`` seen from the page ``base``; null where there is no such URL."""
    start = parse(base)
    url = parse(target, start) if start else None
    return None if url is None else str(url)


@lru_cache(maxsize=50_000)
def parts(href: str) -> tuple | None:
    """(canonical href, scheme, host without brackets, has credentials, path) of a URL, or None."""
    url = parse(href)
    if url is None:
        return None
    path = url.path if isinstance(url.path, str) else "".join("/" + p for p in url.path)
    return canonical_href(href), url.scheme, url.hostname, bool(url.username or url.password), path
