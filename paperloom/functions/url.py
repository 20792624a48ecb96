"""URL expressions: canonical form, paging parameter, path prefixes, address classes."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TRACKING = ("fbclid", "gclid", "msclkid", "twclid", "igshid", "yclid", "mc_cid", "mc_eid", "_ga", "_gl")
TRACKING_PREFIX = "utm_"
DEFAULT_PORTS = {"http": "80", "https": "443"}
LOGIN = r"(?i)(^|[./_-])(login|log-in|signin|sign-in|auth|sso|account)([./?_-]|$)"

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, k)


def is_http(url: Column) -> Column:
    """True for absolute http(s) URLs with a host and, where there is one, a port of digits."""
    host = F.regexp_replace(_part(url, 2), r"^.*@", "")
    named = F.regexp_extract(host, r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$", 1)
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https") & (named != "") & (named != "[]"), F.lit(False))


def canonical_netloc(url: Column) -> Column:
    """User info kept, host in lower case, empty and default ports gone."""
    netloc, scheme = _part(url, 2), F.lower(_part(url, 1))
    user = F.regexp_extract(netloc, r"^(.*@)", 1)
    rest = F.regexp_replace(netloc, r"^.*@", "")
    host = F.lower(F.regexp_extract(rest, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(rest, r"^(?:\[[^\]]*\]|[^:]*):([0-9]+)$", 1)
    number = F.regexp_replace(port, r"^0+(?=[0-9])", "")
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])[scheme]
    return F.concat(user, host, F.when((port == "") | (number == default), "").otherwise(F.concat(F.lit(":"), port)))


def filtered_query(query: Column) -> Column:
    """Without tracking parameters and empty segments; order and encoding stay."""

    def keeps(part: Column) -> Column:
        key = F.lower(F.try_url_decode(F.regexp_extract(part, r"^([^=]*)", 1)))
        key = F.coalesce(key, F.lower(F.regexp_extract(part, r"^([^=]*)", 1)))
        return (part != "") & ~key.isin(*TRACKING) & ~key.startswith(TRACKING_PREFIX)

    return F.array_join(F.filter(F.split(query, "&"), keeps), "&")


def normalize_url(url: Column) -> Column:
    """The canonical URL, null where it isn't an absolute http(s) URL."""
    query = filtered_query(_part(url, 4))
    text = F.concat(F.lower(_part(url, 1)), F.lit("://"), canonical_netloc(url), _part(url, 3), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(is_http(url), text)


def origin(url: Column) -> Column:
    """Host and path of the canonical URL: documents of one origin are one family."""
    return F.regexp_extract(normalize_url(url), r"^[a-z]+://([^?]*)", 1)


def next_page(url: Column, parameter: str, step: int = 1) -> Column:
    """The paging parameter raised by step; appended as 1 + step where it is missing."""
    value = F.regexp_extract(url, rf"[?&]{parameter}=([0-9]+)", 1)
    grown = (F.coalesce(value.try_cast("long"), F.lit(1)) + step).cast("string")
    head = F.regexp_extract(url, rf"^(.*?[?&]{parameter}=)[0-9]+", 1)
    tail = F.regexp_extract(url, rf"^.*?[?&]{parameter}=[0-9]+(.*)$", 1)
    joined = F.concat(url, F.when(F.instr(url, "?") > 0, "&").otherwise("?"), F.lit(f"{parameter}="), grown)
    return F.when(value == "", joined).otherwise(F.concat(head, grown, tail))


def path_allowed(url: Column, prefixes: list[str]) -> Column:
    """A prefix may be a whole URL or a path."""
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.when(p.rlike("^https?://"), F.startswith(url, p)).otherwise(F.startswith(path, p)))


def looks_like_login(url: Column) -> Column:
    return F.coalesce(F.concat(_part(url, 2), _part(url, 3)).rlike(LOGIN), F.lit(False))


@F.pandas_udf(T.StringType())
def address_class(addresses: pd.Series) -> pd.Series:
    """``public``, or why an address must not be fetched; embedded IPv4 addresses count as themselves."""
    shared = ipaddress.ip_network("100.64.0.0/10")

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            ip = ipaddress.ip_address(text.strip("[]"))
        except ValueError:
            return "invalid"
        if ip.version == 6:
            inner = ip.ipv4_mapped or ip.sixtofour or (ip.teredo[1] if ip.teredo else None)
            if inner is not None:
                ip = inner
        for name in ("is_loopback", "is_link_local", "is_multicast", "is_unspecified"):
            if getattr(ip, name):
                return name[3:]
        if ip.version == 4 and ip in shared:
            return "shared"
        return "public" if ip.is_global else "private"

    return addresses.map(one)
