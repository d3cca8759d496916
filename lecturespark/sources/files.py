"""File inventories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

READ_BYTES = 4 << 20
ROWS_PER_BATCH = 10_000


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _lister(root: str, pattern: str, skip: tuple[str, ...], deep: bool):
    """Lists folders: one level, or all levels below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = _open(root)
        cut = len(base.rstrip("/")) + 1
        for batch in batches:
            found = batch[~batch["folder"]].values.tolist()
            open_ = batch["path"][batch["folder"]].tolist()
            while open_:
                folder = open_.pop()
                for entry in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                    path = entry.path[cut:]
                    if entry.type == fs.FileType.Directory:
                        if "/" in path or entry.base_name not in skip:  # only the top level is passed over
                            open_.append(path) if deep else found.append([path, 0, True])
                    elif fnmatch(entry.base_name, pattern):
                        found.append([path, entry.size, False])
                    if len(found) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(found, columns=["path", "size", "folder"])
                        found = []
                if not deep:
                    break
            yield pd.DataFrame(found, columns=["path", "size", "folder"])

    return run


def _hasher(root: str):
    """Hashes files piece by piece, so that a file of any size fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(root)
        for batch in batches:
            digests = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                    while piece := stream.read(READ_BYTES):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield batch[["path", "size"]].assign(sha256=digests)

    return run


def file_inventory(spark: SparkSession, root: str, pattern: str = "*", skip: tuple[str, ...] = (".git",)) -> DataFrame:
    """Path below ``root``, size and SHA-256 of every file, hidden and empty ones included.

    Spark's own file reader passes over empty files and names that start with ``_``
    or ``.``, which an inventory may not. The folders of the root are listed and the
    files hashed as rows of a job; only the root's name passes through the driver.
    """
    schema = "path STRING, size BIGINT, folder BOOLEAN"
    top = spark.createDataFrame([("", 0, True)], schema).mapInPandas(_lister(root, pattern, skip, deep=False), schema)
    files = top.repartition("path").mapInPandas(_lister(root, pattern, skip, deep=True), schema)
    return files.repartition("path").mapInPandas(_hasher(root), "path STRING, size BIGINT, sha256 STRING")
