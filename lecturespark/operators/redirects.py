"""Following recorded redirects and checking renewed URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import authority, host, media_identity, path, scheme, url_reason
from ..session import materialise

MAX_REDIRECTS = 5
REDIRECTS = (301, 302, 303, 307, 308)


def _join_url(base: str, location: Column) -> Column:
    """The absolute form of a redirect target."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_extract(path(base), r"\A(.*/)?[^/]*\z", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (F.when(location.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), location)
            .when(location.startswith("//"), F.concat(scheme(base), F.lit(":"), location))
            .when(location.startswith("/"), F.concat(origin, location))
            .otherwise(F.concat(origin, folder, location)))


def _decided_hops(hops: DataFrame) -> DataFrame:
    """What a lookup of each URL leads to: (url, outcome, target, same_host); ``moved`` goes on at the target."""
    last = hops.groupBy("url").agg(F.max_by(F.struct("status", "location"), F.col("ord")).alias("_hop"))
    hop = F.col("_hop")
    last = last.withColumn("target", _join_url("url", hop["location"]))
    redirect = F.coalesce(hop["status"].isin(*REDIRECTS), F.lit(False))
    reason = url_reason("target")
    outcome = (F.when(redirect & (F.coalesce(hop["location"], F.lit("")) == ""), "redirect_without_location")
               .when(redirect & (reason != "ok"), reason).when(redirect, "moved")
               .when(hop["status"] >= 400, "authorization_http_error").otherwise("ok"))
    return last.select("url", outcome.alias("outcome"), "target", (host("target") == host("url")).alias("same_host"))


def resolve_redirects(starts: DataFrame, hops: DataFrame, keys: list[str], most: int = MAX_REDIRECTS) -> DataFrame:
    """Follow each start URL through at most ``most`` redirects.

    ``hops`` has ``url``, ``status`` and ``location``; the last row per URL counts. Each hop's
    target is computed once. ``most`` + 1 lookups decide every chain, so loops end by the
    bound; rows that are decided leave the loop, and the lineage is cut at every hop.
    ``host_headers`` is false once the host has changed and its headers have been dropped.
    """
    known = materialise(_decided_hops(hops))
    state = starts.select(*keys, F.col("url").alias("current"), F.lit(True).alias("host_headers"), F.lit(0).alias("redirects"),
                          url_reason("url").alias("status"))
    done = [state.where("status <> 'ok'")]
    open_ = state.where("status = 'ok'").drop("status")
    for _ in range(most + 1):
        looked_up = materialise(open_.join(known, open_["current"] == known["url"], "left"))
        outcome = F.coalesce("outcome", F.lit("connection_failed"))
        done.append(looked_up.where(outcome != "moved").select(*keys, "current", "host_headers", "redirects", outcome.alias("status")))
        open_ = looked_up.where("outcome = 'moved'").select(
            *keys, F.col("target").alias("current"), (F.col("host_headers") & F.col("same_host")).alias("host_headers"),
            (F.col("redirects") + 1).alias("redirects"))
        if open_.isEmpty():
            break
    done.append(open_.withColumn("status", F.lit("redirect_limit")))
    return reduce(DataFrame.unionByName, done)


def same_media_identity(urls: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each renewed URL still names the session's media.

    A refused URL does not replace the one in use, so every accepted URL has the
    identity of the session's first. One minimum per session decides all rows.
    """
    first = urls.groupBy(*keys).agg(F.min_by(media_identity("url"), "seq").alias("_first"))
    return urls.join(first, keys).withColumn("accepted", media_identity("url") == F.col("_first")).drop("_first")
