"""URL and header policy as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model_json import strip
from .text import col

# Headers that may be passed on.
ALLOWED_HEADERS = ("accept", "accept-encoding", "accept-language", "cache-control", "cookie", "origin", "pragma",
                   "referer", "user-agent")
# Headers that belong to one host.
HOST_HEADERS = ("cookie", "origin", "referer")

_URL = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(col(url), _URL, 1))


def authority(url) -> Column:
    return F.regexp_extract(col(url), _URL, 2)


def path(url) -> Column:
    return F.regexp_extract(col(url), _URL, 3)


def userinfo(url) -> Column:
    return F.regexp_extract(authority(url), r"\A(.*)@", 1)


def host(url) -> Column:
    return F.lower(F.regexp_extract(authority(url), r"\A(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url) -> Column:
    return F.regexp_extract(authority(url), r":([^:\]]*)\z", 1)


def url_reason(url, allowed_hosts: list[str] | None = None) -> Column:
    """``ok`` or why a URL is refused: HTTPS only, a host, no credentials, port 443."""
    value = strip(F.coalesce(col(url), F.lit("")))
    refused = (scheme(value) != "https") | (host(value) == "") | (F.replace(userinfo(value), F.lit(":"), F.lit("")) != "")
    reason = F.when(refused, "invalid_https_url").when(~port(value).isin("", "443"), "invalid_https_port")
    if allowed_hosts is not None:
        reason = reason.when(~host(value).isin(*allowed_hosts), "host_not_allowed")
    return reason.otherwise("ok")


def media_identity(url) -> Column:
    """What must stay the same when a media URL is renewed."""
    value = F.coalesce(col(url), F.lit(""))
    return F.struct(scheme(value).alias("scheme"), host(value).alias("host"), port(value).alias("port"),
                    path(value).alias("path"))


def _title(name: Column) -> Column:
    return F.translate(F.initcap(F.translate(name, "-", " ")), " ", "-")


def safe_headers(headers) -> Column:
    """The allowed headers under their usual names; null if a value has a line break.

    Of names that differ in case or blanks only, the last one counts.
    """
    named = F.transform(F.map_entries(col(headers)), lambda e: F.struct(_title(F.lower(strip(e["key"]))).alias("key"), e["value"].alias("value")))
    allowed = F.filter(named, lambda e: F.lower(e["key"]).isin(*ALLOWED_HEADERS))
    kept = F.aggregate(allowed, F.array().cast("array<struct<key:string,value:string>>"),
                       lambda done, e: F.concat(F.filter(done, lambda d: d["key"] != e["key"]), F.array(e)))
    broken = F.exists(kept, lambda e: e["value"].rlike(r"[\r\n]"))
    return F.when(~broken, F.map_from_entries(kept))
