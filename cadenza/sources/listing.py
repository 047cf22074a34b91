"""Listings of music folders as DataFrames of (ordinal, path, size_bytes)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.errors import FileMissing, UnsupportedFormat
from cadenza.functions import paths

SCHEMA = "ordinal long, path string, size_bytes long"


def _walk(folder: str, recursive: bool, exclude: str | None) -> Iterator[tuple[str, int]]:
    """Files in order of path, hidden ones too; folders behind links and what can't be read are left out."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        try:
            if e.is_dir(follow_symlinks=False):
                if recursive and os.path.abspath(e.path) != exclude:
                    yield from _walk(e.path, True, exclude)
            elif e.is_file():
                yield e.path, e.stat().st_size
        except OSError:
            continue


def local_listing(spark: SparkSession, root: str, recursive: bool = True, exclude: str | None = None) -> DataFrame:
    """A folder of the driver's file system, or one file, which must be of a supported format.

    A store's own listing (see `store_listing`) hides names that begin with a dot or an underscore; this one doesn't.
    """
    if not os.path.exists(root):
        raise FileMissing(root)
    if os.path.isfile(root):
        if os.path.splitext(root)[1][1:].lower() not in paths.FORMATS:
            raise UnsupportedFormat(root)
        rows = [(0, root, os.path.getsize(root))]
    else:
        rows = [(i, p, n) for i, (p, n) in enumerate(_walk(root, recursive, os.path.abspath(exclude) if exclude else None))]
    return spark.createDataFrame(rows, SCHEMA)


def store_listing(spark: SparkSession, root: str, recursive: bool = True, exclude: str | None = None) -> DataFrame:
    """Any folder that Spark can read, listed in parallel; contents are not read, and files have no ordinal but their path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(root).select(F.lit(None).cast("long").alias("ordinal"), "path", F.col("length").alias("size_bytes"))
    inner = lambda x: re.sub("^file:/+", "/", x).rstrip("/") + "/"  # noqa: E731  one spelling of a local path
    return found if exclude is None else found.where(~F.regexp_replace("path", "^file:/+", "/").startswith(inner(exclude)))


def is_file(path: str) -> bool:
    """Is there a file at a local path?"""
    return os.path.isfile(path)
