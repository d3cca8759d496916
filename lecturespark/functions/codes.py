"""Reducing free text and responses to closed sets of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Codes of recogniser errors.
ASR_CODES = {
    "authorized media duration probe timed out": "duration_probe_timeout",
    "authorized media duration could not be determined": "duration_probe_failed",
    "configured ASR model directory is incomplete": "model_incomplete",
    "configured ASR token file is missing": "model_tokens_missing",
    "unsupported ASR backend": "unsupported_backend",
    "unsupported subtitle mode": "unsupported_mode",
    "media start is invalid": "invalid_start",
    "media duration is missing or outside the supported range": "invalid_duration",
    "checkpoint subtitle mode does not match the job": "checkpoint_mode_mismatch",
    "authorized media decode timed out": "media_decode_timeout",
    "ffmpeg could not decode the authorized media stream": "media_decode_failed",
    "authorized media request returned HTTP 401": "media_http_401",
    "authorized media request returned HTTP 403": "media_http_403",
    "authorized media request returned HTTP 404": "media_http_404",
    "authorized media request returned HTTP 429": "media_http_429",
    "authorized media request returned HTTP 4xx": "media_http_4xx",
    "authorized media request returned HTTP 5xx": "media_http_5xx",
    "authorized media request returned an unsupported status": "media_http_status_rejected",
    "authorized media response contained HTML": "media_content_html",
    "authorized media response contained JSON": "media_content_json",
    "authorized media signature was rejected": "media_magic_rejected",
    "authorized media is missing a readable MP4 index": "media_index_unreadable",
    "authorized media format was rejected by ffmpeg": "media_format_rejected",
    "authorized media request returned an unsupported redirect": "media_redirect_rejected",
    "authorized media upstream connection failed": "media_connection_failed",
    "authorized media proxy target was rejected": "media_proxy_target_rejected",
    "authorized media proxy request was rejected": "media_proxy_request_rejected",
    "ffmpeg requested an invalid media range": "media_range_invalid",
}
# Codes of source errors, exact texts first, then beginnings.
SOURCE_CODES = {
    "source header contains a line break": "header_line_break",
    "source must be an authenticated-free HTTPS URL": "invalid_https_url",
    "source uses a non-HTTPS port": "invalid_https_port",
    "source host could not be resolved": "dns_resolution_failed",
    "source host has no addresses": "dns_no_addresses",
    "source resolved to a non-public address": "non_public_address",
    "source supplied an invalid public address": "invalid_public_address_hint",
    "source redirect has no location": "redirect_without_location",
    "source exceeded the redirect limit": "redirect_limit",
    "source image exceeds the size limit": "image_size_limit",
}
SOURCE_PREFIXES = {
    "source request failed:": "connection_failed",
    "source authorization probe returned HTTP ": "authorization_http_error",
    "source image returned HTTP ": "image_http_error",
}
# Platform errors that may be named; the first two take a stage.
PLATFORM_STAGED = ("platform_connection_failed", "platform_session_rejected")
PLATFORM_CODES = (
    "platform_credentials_missing", "platform_connection_failed", "platform_redirect_rejected",
    "platform_auth_context_missing", "platform_auth_method_missing", "platform_key_rejected", "platform_auth_failed",
    "platform_ticket_missing", "platform_ticket_rejected", "platform_session_rejected",
    "platform_course_context_missing", "platform_course_request_failed", "platform_media_missing",
)
FAMILY_DEFAULTS = {"asr": "asr_error", "source": "source_security_error", "platform": "platform_session_failed"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def error_code(family, message, stage=None, stages: tuple[str, ...] = ()) -> Column:
    """The code of an error message, or its family's default; the text is never passed on."""
    kind, text = col(family), F.coalesce(col(message), F.lit(""))
    source = F.coalesce(_lookup(SOURCE_CODES, text), *[
        F.when(F.startswith(text, F.lit(start)), code) for start, code in SOURCE_PREFIXES.items()])
    platform = F.when(text.isin(*PLATFORM_CODES), text)
    if stage is not None and stages:
        staged = text.isin(*PLATFORM_STAGED) & col(stage).isin(*stages)
        platform = F.when(staged, F.concat(text, F.lit("_"), col(stage))).otherwise(platform)
    found = F.when(kind == "asr", _lookup(ASR_CODES, text)).when(kind == "source", source).when(kind == "platform", platform)
    return F.coalesce(found, _lookup(FAMILY_DEFAULTS, kind), F.lit(""))


def upstream_code(status) -> Column:
    """Code of a refused upstream status; accepted ones have none."""
    value = col(status)
    return (F.when(value.isin(200, 206, 416), None)
            .when(value.isin(301, 302, 303, 307, 308), "upstream_redirect")
            .when(value.isin(401, 403, 404, 429), F.concat(F.lit("upstream_http_"), value.cast("string")))
            .when(value.between(500, 599), "upstream_http_5xx").otherwise("upstream_http_other"))


def decoder_code(stderr) -> Column:
    """Classify decoder output; the first matching class wins."""
    text = F.lower(F.coalesce(col(stderr), F.lit("")))

    def has(*needles: str) -> Column:
        found = F.lit(False)
        for needle in needles:
            found = found | F.contains(text, F.lit(needle))
        return found

    code = F.when(F.lit(False), "")
    for status in ("401", "403", "404", "429"):
        code = code.when(has(f"server returned {status}", f"http error {status}", f"returned error: {status}"),
                         f"media_http_{status}")
    return (code.when(has("server returned 5", "http error 5"), "media_http_5xx")
            .when(has("moov atom"), "media_index_unreadable")
            .when(has("invalid data"), "media_format_rejected").otherwise("media_decode_failed"))


def response_http(status) -> Column:
    value = F.coalesce(col(status), F.lit(0))
    code = F.when(value.isin(401, 403, 404, 429), F.concat(F.lit("http_"), value.cast("string")))
    for hundred in (2, 3, 4, 5):
        code = code.when(value.between(hundred * 100, hundred * 100 + 99), f"http_{hundred}xx")
    return code.otherwise("http_other")


def response_content(content_type) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(col(content_type), F.lit("")), ";", 1)))
    return (F.when(kind == "", "content_missing").when(kind.startswith("video/"), "content_video")
            .when(kind.isin("text/html", "application/xhtml+xml"), "content_html")
            .when((kind == "application/json") | kind.endswith("+json"), "content_json").otherwise("content_other"))


def response_magic(prefix) -> Column:
    """Kind of a body (text or binary column) by how it starts, after any number of blanks."""
    whole = F.coalesce(F.to_binary(F.hex(col(prefix)), F.lit("hex")), F.lit(b""))
    # One character per byte, so that positions are byte positions.
    text = F.decode(whole, "ISO-8859-1")
    start = F.lower(F.substring(F.ltrim(text, F.lit(" \t\n\r\x0b\x0c")), 1, 16))
    html = F.lit(False)
    for tag in ("<!doctype html", "<html", "<head", "<body"):
        html = html | F.startswith(start, F.lit(tag))
    return (F.when((F.length(text) >= 12) & (F.substring(text, 5, 4) == "ftyp"), "magic_iso_bmff")
            .when(html, "magic_html")
            .when(F.startswith(start, F.lit("{")) | F.startswith(start, F.lit("[")), "magic_json")
            .otherwise("magic_unknown"))


def response_verdict(http, content, magic) -> Column:
    """Code of a refused media response, or null; status before content before signature."""
    h, c, m = col(http), col(content), col(magic)
    return (F.when(h.isin("http_401", "http_403", "http_404", "http_429", "http_4xx", "http_5xx"),
                   F.concat(F.lit("media_"), h))
            .when(h == "http_3xx", "media_redirect_rejected").when(h == "http_other", "media_http_status_rejected")
            .when((c == "content_html") | (m == "magic_html"), "media_content_html")
            .when((c == "content_json") | (m == "magic_json"), "media_content_json")
            .when(m != "magic_iso_bmff", "media_magic_rejected"))
