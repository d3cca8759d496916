"""Manifests: entries, order, differences, revocation and digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import canonical_json
from ..functions.model_json import strip
from .scan import OrderedRows, Running, document_parts, list_positions

# File modes a manifest may list and the codes of a refused one.
MODES = ("100644", "100755")
INVALID = "worker_manifest_invalid"
REVOKED = "worker_signing_key_revoked"
ENTRIES_PER_PART = 1000


def entry_reason(metadata_paths: tuple[str, ...] = ()) -> Column:
    """Why a manifest entry is refused, or ``ok``."""
    path = F.translate(F.coalesce("path", F.lit("")), "\\", "/")
    bad_path = (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    if metadata_paths:
        bad_path = bad_path | path.isin(*metadata_paths)
    digest = F.lower(strip(F.coalesce("sha256", F.lit(""))))
    return (F.when(bad_path, "path").when(~F.coalesce("mode", F.lit("")).isin(*MODES), "mode")
            .when(F.coalesce("size", F.lit(-1)) < 0, "size").when(~digest.rlike(r"\A[0-9a-f]{64}\z"), "sha256").otherwise("ok"))


def manifest_order(entries: DataFrame, keys: list[str], **options) -> DataFrame:
    """Flags entries that sort before the entry above them and paths listed twice."""
    rows = OrderedRows(entries, keys, ["ord"], **options)
    rows = rows.running(_prev=Running("max", F.struct("ord", "path"), exclusive=True))
    ordered = rows.result().withColumn(
        "out_of_order", F.coalesce(F.col("_prev")["path"] > F.col("path"), F.lit(False))).drop("_prev")
    copies = entries.groupBy(*keys, "path").agg((F.count(F.lit(1)) > 1).alias("duplicate"))
    return ordered.join(copies, [*keys, "path"])


def manifest_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Every path: ok, unknown, digest_mismatch or missing; a null size or digest equals only a null."""
    a = actual.select(*keys, "path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_there"))
    both = expected.select(*keys, "path", "size", "sha256", F.lit(True).alias("_listed")).join(a, [*keys, "path"], "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("sha256").eqNullSafe(F.col("_sha"))
    status = (F.when(F.col("_listed").isNull(), "unknown").when(F.col("_there").isNull(), "missing")
              .when(~same, "digest_mismatch").otherwise("ok"))
    return both.select(*keys, "path", status.alias("status"))


def missing_files(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Listed paths that no file has."""
    return expected.select(*keys, "path").join(actual.select(*keys, "path"), [*keys, "path"], "left_anti")


def revocation_check(manifests: DataFrame, signing_keys: DataFrame, revoked: DataFrame) -> DataFrame:
    """Signing key first, then the digest itself."""
    known = signing_keys.select("key_id", F.col("status").alias("key_status"))
    listed = revoked.select(F.lower("digest").alias("digest")).distinct().withColumn("_revoked", F.lit(True))
    joined = manifests.join(known, "key_id", "left").join(listed, "digest", "left")
    code = (F.when(F.col("key_status").isNull(), INVALID)
            .when((F.col("key_status") == "revoked") | F.col("_revoked"), REVOKED).otherwise("ok"))
    return joined.withColumn("status", code).drop("_revoked")


def shared_versions(offered: str, supported: tuple[str, ...] = ("2",)) -> Column:
    """Protocol versions both sides know."""
    return F.array_intersect(F.col(offered), F.array(*[F.lit(v) for v in supported]))


def _hash_parts(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = None, None
        for batch in batches:
            done = []
            for row in batch[[*keys, "text"]].itertuples(index=False, name=None):
                if row[:-1] != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = row[:-1], hashlib.sha256()
                digest.update(row[-1].encode("utf-8"))
            yield pd.DataFrame(done, columns=[*keys, "tree_sha256"])
        if digest is not None:
            yield pd.DataFrame([(*current, digest.hexdigest())], columns=[*keys, "tree_sha256"])

    return run


def _tree_parts(entries: DataFrame, keys: list[str], per_part: int, **options) -> DataFrame:
    """The canonical JSON list of each manifest's entries, in parts of ``per_part`` entries."""
    numbered = list_positions(entries, keys, ["ord"], **options)
    entry = canonical_json(["mode", "path", "sha256", "size"])
    pieces = numbered.select(*keys, F.col("idx").alias("ord"),
                             F.concat(F.when(F.col("idx") > 0, ",").otherwise("["), entry).alias("piece"))
    ends = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("ord")).withColumn("piece", F.lit("]"))
    return document_parts(pieces.unionByName(ends), keys, "ord", "piece", per_part)


def tree_digest_levels(entries: DataFrame, keys: list[str], per_part: int = ENTRIES_PER_PART, **options) -> DataFrame:
    """A digest of each manifest that no single task computes: the SHA-256 of the digests of its parts, in order.

    Parts hold ``per_part`` entries of the text that ``tree_digest`` hashes whole.
    """
    parts = _tree_parts(entries, keys, per_part, **options).select(*keys, "part", F.sha2("text", 256).alias("digest"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "digest")))
    return parts.groupBy(*keys).agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda p: p["digest"])), 256).alias("tree_sha256"))


def tree_digest(entries: DataFrame, keys: list[str], **options) -> DataFrame:
    """SHA-256 of each manifest's entries as one canonical JSON list.

    The text is built in parallel in bounded parts. The hash itself is defined over
    the whole text in order, so it takes the parts of a manifest one after the other
    and keeps only its state; a manifest is never held as a whole.
    """
    parts = _tree_parts(entries, keys, ENTRIES_PER_PART, **options)
    schema = ", ".join([f"`{k}` {entries.schema[k].dataType.simpleString()}" for k in keys] + ["tree_sha256 STRING"])
    return parts.repartition(*keys).sortWithinPartitions(*keys, "part").mapInPandas(_hash_parts(keys), schema)
