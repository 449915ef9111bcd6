"""Canonical URLs: the http(s) part of the URL standard, scope, origin and extension.

Plain functions hold the full rules; ``*_column`` forms are Spark expressions over canonical URLs. Errors are
the three labels below and never carry the URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

try:
    import idna
except ImportError:  # host names beyond ASCII then go through Python's own, older table
    idna = None

INVALID, UNSUPPORTED, CREDENTIALS = "InvalidUrl", "UnsupportedUrl", "CredentialsNotAllowed"
#: Default ports, and the characters that each part percent-encodes besides controls and non-ASCII.
PORTS = {"http": 80, "https": 443}
PATH_ENCODED = set(' "#<>?`{}')
QUERY_ENCODED = set(" \"#<>'")
FORBIDDEN_HOST = set("\0\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(c) for c in range(32)}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")


class UrlError(ValueError):
    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str
    port: int | None
    path: str
    query: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port is not None else "")

    def __str__(self) -> str:
        return self.origin + self.path + ("" if self.query is None else f"?{self.query}")


def _encode(text: str, more: set[str]) -> str:
    if text.isascii() and not any(c in more or c < " " or c == "\x7f" for c in text):
        return text
    return "".join(c if c.isascii() and c not in more and " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4_number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        if len(part) > 1 and part[0] == "0":
            return int(part, 8)
        return int(part) if part.isascii() and part.isdigit() else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """Dotted form if the last label is a number; None if the host is a name."""
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    last = labels[-1]
    if not (last.isascii() and last.isdigit()) and _ipv4_number(last) is None:
        return None
    if not (last and (last.isdigit() or last[:2].lower() == "0x")):
        return None
    numbers = [_ipv4_number(x) if x else None for x in labels]
    if len(labels) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise UrlError(INVALID)
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ascii_label(label: str) -> str:
    if label.isascii():
        return label
    return "xn--" + label.encode("punycode").decode()


def _host(raw: str) -> str:
    if raw.startswith("["):
        import ipaddress

        if not raw.endswith("]"):
            raise UrlError(INVALID)
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1])}]"
        except ValueError:
            raise UrlError(INVALID) from None
    if "%" in raw:
        from urllib.parse import unquote

        raw = unquote(raw, errors="replace")
    if raw.isascii():
        host = raw.lower()
    else:
        try:
            mapped = idna.uts46_remap(raw, std3_rules=False, transitional=False) if idna else raw.encode("idna").decode()
        except (UnicodeError, ValueError):
            raise UrlError(INVALID) from None
        host = ".".join(_ascii_label(x) for x in re.split("[.。．｡]", mapped.lower()))
    if not host or any(c in FORBIDDEN_HOST for c in host):
        raise UrlError(INVALID)
    return _ipv4(host) or host


def _path(segments: list[str], text: str) -> str:
    """Append ``text`` to ``segments``, dot segments resolved."""
    parts = re.split(r"[/\\]", text)
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if plain == "..":
            if segments:
                segments.pop()
            if last:
                segments.append("")
        elif plain == ".":
            if last:
                segments.append("")
        else:
            segments.append(_encode(part, PATH_ENCODED))
    return "/" + "/".join(segments)


def parse(text: str | None, base: Url | None = None) -> Url:
    """The URL of ``text``, resolved against ``base`` if there is one, without its fragment."""
    if text is None:
        raise UrlError(INVALID)
    text = re.sub("[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    text = text.partition("#")[0]
    found, scheme, rest = _SCHEME.match(text), None, text
    if found:
        scheme, rest = found[1].lower(), text[found.end() :]
        if scheme not in PORTS:
            raise UrlError(UNSUPPORTED)
        if base is not None and scheme == base.scheme and rest[:1] not in ("/", "\\"):
            scheme = None
        else:
            rest = "//" + rest.lstrip("/\\")
    elif base is None:
        raise UrlError(INVALID)
    before, mark, query = rest.partition("?")
    query = _encode(query, QUERY_ENCODED) if mark else None
    if scheme is None and before[:1] not in ("/", "\\"):
        if not before:
            return Url(base.scheme, base.host, base.port, base.path, query if mark else base.query)
        kept = base.path[1:].split("/")[:-1]
        return Url(base.scheme, base.host, base.port, _path(kept, before), query)
    if scheme is None and before[1:2] not in ("/", "\\"):
        return Url(base.scheme, base.host, base.port, _path([], before[1:]), query)
    scheme = scheme or base.scheme
    before = before[2:].lstrip("/\\")
    cut = re.search(r"[/\\]", before)
    authority, path = (before[: cut.start()], before[cut.end() :]) if cut else (before, "")
    user, at, place = authority.rpartition("@")
    if at and user.strip(":"):
        raise UrlError(CREDENTIALS)
    port = None
    if (colon := re.search(r":([^\]:]*)$", place)) and not place.endswith("]"):
        place, digits = place[: colon.start()], colon[1]
        if digits and not (digits.isascii() and digits.isdigit() and int(digits) <= 65535):
            raise UrlError(INVALID)
        port = int(digits) if digits else None
        if port == 0:
            raise UrlError(UNSUPPORTED)
        port = None if port == PORTS[scheme] else port
    if not place:
        raise UrlError(INVALID)
    return Url(scheme, _host(place), port, _path([], path), query)


def canonical(text: str | None) -> tuple[str | None, str | None]:
    """(canonical URL, error): one of the two is None."""
    try:
        return str(parse(text)), None
    except UrlError as e:
        return None, e.kind


def resolve(base: Url, reference: str) -> str | None:
    try:
        return str(parse(reference, base))
    except UrlError:
        return None


def extension(path: str) -> str:
    """Lower-cased text after the last dot of the last segment, if both sides have some; else ``html``."""
    stem, dot, ext = path.rsplit("/", 1)[-1].rpartition(".")
    return ext.lower() if dot and stem and ext else "html"


def in_scope(url: Url, base: Url) -> bool:
    return url.origin == base.origin and str(url).startswith(str(base))


# ---------------------------------------------------------------- columns

CANONICAL = StructType([StructField("url", StringType()), StructField("error", StringType())])
#: What the fast path takes as it is: lower-case host, plain path, no dot segments, port or credentials.
PLAIN = r"\Ahttps?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)*/(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*/?)*(?:\?[A-Za-z0-9._~=&%/-]*)?(?:#[^\t\n\r\x00-\x20]*)?\z"

canonical_url = F.udf(canonical, CANONICAL, useArrow=True)
resolve_url = F.udf(lambda base, ref: resolve(parse(base), ref) if base is not None and ref is not None and canonical(base)[0] else None, StringType(), useArrow=True)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*\z", "")


def with_canonical(df: DataFrame, column: str, to: str = "canonical", error: str = "url_error") -> DataFrame:
    """Add the canonical URL and an error label. Plain URLs stay in the JVM; only others reach Python."""
    plain = F.coalesce(F.col(column).rlike(PLAIN), F.lit(False))
    fast = df.where(plain).withColumns({to: drop_fragment(F.col(column)), error: F.lit(None).cast("string")})
    slow = df.where(~plain).withColumn("__parsed", canonical_url(column))
    slow = slow.withColumns({to: F.col("__parsed.url"), error: F.col("__parsed.error")}).drop("__parsed")
    return fast.unionByName(slow)


def origin_column(url: Column) -> Column:
    """Scheme, host and port of a canonical URL."""
    return F.regexp_extract(url, r"\A([a-z]+://[^/?#]*)", 1)


def path_column(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[a-z]+://[^/?#]*([^?#]*)", 1)


def extension_column(url: Column) -> Column:
    ext = F.regexp_extract(F.element_at(F.split(path_column(url), "/"), -1), r"(?s)\A.+\.([^.]+)\z", 1)
    return F.when(ext == "", "html").otherwise(F.lower(ext))


def in_scope_column(url: Column, base: Column) -> Column:
    return (origin_column(url) == origin_column(base)) & url.startswith(base)
