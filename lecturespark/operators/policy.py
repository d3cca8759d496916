"""Scanning texts, paths, links and addresses against rules."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_json import strip

# What may not be stored or written down.
FORBIDDEN_SUFFIXES = (
    ".aac", ".avi", ".flac", ".m3u8", ".m4a", ".mkv", ".mov", ".mp3",
    ".mp4", ".srt", ".ssa", ".ass", ".ts", ".vtt", ".wav", ".webm",
)
PRIVATE_PREFIXES = (
    "archive.py", "credentials.py", "frontend/", "runtime-assets.json",
    "src/api/", "src/runtime/", "src/remote/github_app.py", "vendor/",
)
CODE_RULES = {
    "course platform module": r"(?i)(?:src\.)?api\.(?:icourse|webvpn)",
    "course URL acquisition": r"(?i)\b(?:get_video_url|get_sub_info|sign_video_url)\b",
    "original media persistence": r"(?i)\b(?:download_video|resume_download|archive_video)\b",
    "student credential": r"\b(?:student_id|UISPsw|StuId)\b",
    "platform host": r"(?i)(?:icourse|webvpn)[-\.][a-z0-9.-]+",
}
DOC_RULES = {
    "platform host": r"(?i)(?:icourse|webvpn)[-\.][a-z0-9.-]+",
    "credential example": r"(?i)\b(?:student[_ -]?id|password|api[_ -]?key|token)\s*[:=]\s*[^\s`]{4,}",
    "direct media URL": r"(?i)https?://\S+\.(?:mp4|m3u8|ts)(?:\?\S*)?",
    "media download command": r"(?i)\b(?:curl|wget|yt-dlp)\b[^\n]*(?:mp4|m3u8|media|video)",
}
CONNECTOR_RULE = ("connector persistence", r"\b(?:write_bytes|NamedTemporaryFile|mkstemp)\b")
# Lower-case texts of which every match of a rule has one.
FACTORS = {
    "course platform module": ("api.icourse", "api.webvpn"), "course URL acquisition": ("get_video_url", "get_sub_info", "sign_video_url"),
    "original media persistence": ("download_video", "resume_download", "archive_video"), "student credential": ("student_id", "uispsw", "stuid"),
    "platform host": ("icourse", "webvpn"), "credential example": ("student", "password", "api", "token"), "direct media URL": ("http",),
    "media download command": ("curl", "wget", "yt-dlp"), "connector persistence": ("write_bytes", "namedtemporaryfile", "mkstemp"),
}
CONNECTOR_EXEMPT = ("course platform module", "course URL acquisition", "student credential", "platform host")
CODE_SUFFIXES = (".py", ".yml", ".yaml", ".sh")

# IPv4 ranges that are not public, first and last address.
RESERVED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)
# IPv6 networks that are not public, those inside them that are, and the prefix of mapped IPv4 addresses.
RESERVED_IPV6 = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
PUBLIC_IPV6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MAPPED_IPV4 = "00000000000000000000ffff"


def suffix(path: str) -> Column:
    """Lower-case file suffix; a leading dot is part of the name."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def text_problem(raw: str) -> Column:
    """``invalid_utf8``, ``replacement_character`` or ``nul_byte`` of a binary column, else null."""
    valid = F.is_valid_utf8(raw)
    text = F.try_validate_utf8(raw)
    return (F.when(~valid, "invalid_utf8").when(F.contains(text, F.lit("�")), "replacement_character")
            .when(F.contains(text, F.lit("\0")), "nul_byte"))


def path_problems(path: str) -> Column:
    """Rules a path breaks, as an array."""
    clean = F.translate(path, "\\", "/")
    private = F.lit(False)
    for start in PRIVATE_PREFIXES:
        private = private | clean.startswith(start)
    return F.array_compact(F.array(F.when(private, F.lit("private client path")),
                                   F.when(suffix(path).isin(*FORBIDDEN_SUFFIXES), F.lit("media or subtitle file"))))


@dataclass(frozen=True)
class ScanRule:
    """A pattern, where it applies, and its literal factors.

    ``factors``: lower-case texts of which every match has one, upper or lower case; without any,
    the pattern is tried on every text in scope. ``prefixes``, ``suffixes`` and ``endings`` say
    which paths are in scope (none: all), ``exempt`` which endings of paths are not.
    """

    name: str
    pattern: str
    factors: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    exempt: tuple[str, ...] = ()


MAX_RULES = 1000


def rules_of(table: DataFrame) -> list[ScanRule]:
    """The rules of a table with the columns of ``ScanRule`` (arrays; absent ones are empty), at most ``MAX_RULES``."""
    names = [f.name for f in fields(ScanRule)]
    rows = table.select(*[c for c in names if c in table.columns]).orderBy("name", "pattern").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    tuples = lambda value: value if isinstance(value, str) else tuple(value or ())
    return [ScanRule(**{k: tuples(v) for k, v in row.asDict().items()}) for row in rows]


def scan_rules(files: DataFrame, rules: DataFrame | Sequence[ScanRule], path: str = "path", text: str = "text") -> DataFrame:
    """Each rule broken by each file, one row per pair that breaks; ``files`` without the text, with ``rule``.

    One pass over a text looks for any factor of any rule. Where there is none, that is all.
    Elsewhere a rule's pattern runs if one of its own factors occurs. The rules are expressions
    over the row, so nothing is joined, and only broken rules become rows. Null texts and
    null paths break nothing that asks for them.
    """
    rules = rules_of(rules) if isinstance(rules, DataFrame) else list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")

    def any_of(tests: list[Column]) -> Column:
        return reduce(lambda x, y: x | y, tests, F.lit(False))

    def scope(rule: ScanRule) -> Column:
        inside = F.lit(True)
        if rule.prefixes:
            inside = inside & any_of([F.col(path).startswith(p) for p in rule.prefixes])
        if rule.suffixes:
            inside = inside & F.col("_suffix").isin(*rule.suffixes)
        if rule.endings:
            inside = inside & any_of([F.col(path).endswith(e) for e in rule.endings])
        return inside & ~any_of([F.col(path).endswith(e) for e in rule.exempt]) if rule.exempt else inside

    factors = sorted({f for r in rules for f in r.factors})
    quoted = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", f) for f in factors)
    some = F.col("_lower").rlike(quoted) if factors else F.lit(False)
    marked = files.withColumn("_lower", F.lower(text)).withColumns({"_some": some, "_suffix": suffix(path)})

    def broken(rule: ScanRule) -> Column:
        near = F.col("_some") & any_of([F.contains("_lower", F.lit(f)) for f in rule.factors]) if rule.factors else F.lit(True)
        return F.when(scope(rule) & near & F.col(text).rlike(rule.pattern), F.lit(rule.name))

    found = F.array_compact(F.array(*[broken(r) for r in rules])) if rules else F.array().cast("array<string>")
    return marked.withColumn("rule", F.explode(found)).drop(text, "_lower", "_some", "_suffix")


def default_rules(code_prefixes: tuple[str, ...], doc_prefixes: tuple[str, ...], connectors: tuple[str, ...] = ()) -> list[ScanRule]:
    """The fixed rules for code, documents and the files that may connect."""
    code = [ScanRule(name, pattern, FACTORS[name], code_prefixes, CODE_SUFFIXES, (), connectors if name in CONNECTOR_EXEMPT else ())
            for name, pattern in CODE_RULES.items()]
    name, pattern = CONNECTOR_RULE
    connector = [ScanRule(name, pattern, FACTORS[name], code_prefixes, CODE_SUFFIXES, connectors)] if connectors else []
    return [*code, *connector, *[ScanRule(name, pattern, FACTORS[name], doc_prefixes, (".md",)) for name, pattern in DOC_RULES.items()]]


def rule_scan(files: DataFrame, *, code_prefixes: tuple[str, ...], doc_prefixes: tuple[str, ...],
              connectors: tuple[str, ...] = (), path: str = "path", text: str = "text") -> DataFrame:
    """``scan_rules`` with the fixed rules; a scope without prefixes has no files."""
    rules = [r for r in default_rules(code_prefixes, doc_prefixes, connectors) if r.prefixes]
    return scan_rules(files, rules, path, text)


def violation_report(violations: DataFrame, by: list[str]) -> DataFrame:
    """Broken rules counted."""
    return violations.groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("violations"))


def _normal_path(path: Column) -> Column:
    """Resolve ``.`` and ``..``; a path above the root keeps a leading ``..``."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                .otherwise(F.concat(done, F.array(part))))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat_ws("/", parts)


def link_targets(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Local link targets of Markdown texts with the path each one means."""
    raw = F.explode(F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]]+\]\(([^)]+)\)"), F.lit(1)))
    links = docs.select(path, raw.alias("_raw"))
    target = F.regexp_replace(F.regexp_extract(strip("_raw"), r"(?U)\A([^\s\x1c-\x1f]+)", 1), r"\A[<>]+|[<>]+\z", "")
    links = links.select(path, target.alias("target")).where(
        (F.col("target") != "") & ~F.col("target").rlike(r"\A(?:#|http://|https://|mailto:)"))
    # A plus sign is itself in a path, not a space.
    plain = F.replace(F.substring_index("target", "#", 1), F.lit("+"), F.lit("%2B"))
    relative = F.coalesce(F.try_url_decode(plain), F.substring_index("target", "#", 1))
    folder = F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)
    joined = F.when(relative.startswith("/"), F.concat(F.lit("../"), relative)).otherwise(F.concat_ws("/", folder, relative))
    return links.withColumn("resolved", _normal_path(joined))


def dangling_links(docs: DataFrame, paths: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Links that leave the tree or point to neither a file nor a folder in it."""
    links = link_targets(docs, path, text)
    outside = F.col("resolved").rlike(r"\A\.\.(?:/|\z)")
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.concat_ws("/", F.slice(names, 1, n)))
    existing = paths.select(F.explode(above).alias("resolved")).distinct().withColumn("_found", F.lit(True))
    found = links.join(existing, "resolved", "left")
    problem = F.when(outside, "escapes").when((F.col("resolved") != "") & F.col("_found").isNull(), "missing")
    return found.select(path, "target", problem.alias("problem")).where("problem IS NOT NULL")


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once and not written out at each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv4_number(address: str | Column) -> Column:
    """A dotted quad as a number, or null."""
    text = F.col(address) if isinstance(address, str) else address
    quad = r"(?:0|[1-9]\d{0,2})"

    def number(parts: Column) -> Column:
        whole = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
        return F.when(~F.exists(parts, lambda p: p > 255), whole)

    # The cast is inside: parts of other texts are no numbers.
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("bigint"))
    return F.when(text.rlike(rf"\A{quad}(?:\.{quad}){{3}}\z"), _once(parts, number))


def _quad(text: str) -> int:
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    return value


def ipv6_digits(address: str | Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, or null; the last four bytes may be a dotted quad."""
    def plain(text: Column, quad: Column) -> Column:
        tail = _once(ipv4_number(quad), lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535)))))
        return F.when(quad == "", text).otherwise(F.lower(F.concat(F.regexp_extract(text, r"\A(.*:)[^:]*\z", 1), tail)))

    def groups(halves: Column, n: int) -> Column:
        half = F.get(halves, F.lit(n))
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: (half != ""))

    def full(halves: Column, left: Column, right: Column) -> Column:
        missing = 8 - F.size(left) - F.coalesce(F.size(right), F.lit(0))
        return F.when((F.size(halves) == 1) & (missing == 0), left).when(
            (F.size(halves) == 2) & (missing > 0), F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def padded(groups: Column) -> Column:
        good = F.forall(groups, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
        return F.when(good, F.concat_ws("", F.transform(groups, lambda g: F.lpad(g, 4, "0"))))

    def digits(halves: Column) -> Column:
        return _once(groups(halves, 0), lambda left: _once(groups(halves, 1), lambda right: _once(full(halves, left, right), padded)))

    lowered = F.lower(F.col(address) if isinstance(address, str) else address)
    return _once(lowered, lambda text: _once(F.regexp_extract(text, r":(\d+(?:\.\d+){3})\z", 1), lambda quad: _once(F.split(plain(text, quad), "::"), digits)))


def _any_between(value: Column, ranges) -> Column:
    found = F.lit(False)
    for low, high in ranges:
        found = found | value.between(low, high)
    return found


def _digit_ranges(networks: tuple[str, ...]) -> list[tuple[str, str]]:
    nets = [ipaddress.IPv6Network(n) for n in networks]
    return [(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for n in nets]


def address_status(address: str) -> Column:
    """``public``, ``non_public`` or ``unreadable``; an IPv4 address inside an IPv6 one counts as itself."""
    def status(digits: Column, number: Column) -> Column:
        reserved4 = _any_between(number, [(_quad(low), _quad(high)) for low, high in RESERVED_IPV4])
        reserved6 = _any_between(digits, _digit_ranges(RESERVED_IPV6)) & ~_any_between(digits, _digit_ranges(PUBLIC_IPV6))
        return (F.when(number.isNotNull(), F.when(reserved4, "non_public").otherwise("public"))
                .when(digits.isNull(), "unreadable").when(reserved6, "non_public").otherwise("public"))

    def numbered(digits: Column) -> Column:
        inner = F.when(digits.startswith(MAPPED_IPV4), F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))
        return _once(F.coalesce(ipv4_number(address), inner), lambda number: status(digits, number))

    return _once(ipv6_digits(address), numbered)


def host_addresses(addresses: DataFrame, keys: list[str]) -> DataFrame:
    """A host is refused unless all its addresses are public; else the preferred one is named.

    Preferred is the first IPv4 address, else the first of all. An unreadable or null address refuses its host.
    """
    rank = F.struct(ipv4_number("ip").isNull(), F.col("ord"))
    hosts = addresses.groupBy(*keys).agg(
        F.bool_or(address_status("ip") != "public").alias("_bad"), F.min_by("ip", rank).alias("preferred"))
    return hosts.select(*keys, F.when(F.col("_bad"), "non_public_address").otherwise("ok").alias("status"),
                        F.when(~F.col("_bad"), F.col("preferred")).alias("preferred"))
