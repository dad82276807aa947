"""Listing of media files."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.media import KNOWN, SCANNED, kind_by_extension
from cuewright.functions.paths import base_name, extension

#: Directories that a scan leaves out.
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", ".env", "env", "__pycache__", ".mypy_cache", ".pytest_cache", "node_modules", ".cache",
    ".local", ".Trash", "lost+found", ".DS_Store", "__MACOSX", "Thumbs.db", "desktop.ini", "dist", "build", ".egg-info", ".idea", ".vscode",
)
SCHEMA = "file_path string, media_type string, file_size_bytes bigint, last_modified timestamp"


def kept_path(path: Column, excluded: Iterable[str] | None = None, root: str = "") -> Column:
    """True for files that a scan keeps: no directory below ``root`` excluded or hidden, the file not
    hidden, its extension known. An empty list of exclusions means the usual ones."""
    names = list(excluded or ()) or list(EXCLUDED_DIRS)
    below = F.regexp_replace(path, "^" + "".join("\\" + c if not c.isalnum() else c for c in root.rstrip("/")) + "/*", "") if root else path
    parents = F.filter(F.slice(F.split(below, r"[/\\]"), 1, F.greatest(F.size(F.split(below, r"[/\\]")) - 1, F.lit(0))), lambda p: p != "")
    clean = ~F.exists(parents, lambda p: p.isin(*names) | (p.startswith(".") & (p != ".") & (p != "..")))
    return F.coalesce(clean & ~base_name(path).startswith(".") & kind_by_extension(extension(path)).isNotNull(), F.lit(False))


def select_assets(files: DataFrame, path: str = "path", excluded: Iterable[str] | None = None) -> DataFrame:
    """The files of a listing that a scan keeps, with their kind. Null paths are left out."""
    return files.where(kept_path(F.col(path), excluded)).withColumn("media_type", kind_by_extension(extension(F.col(path))))


def scan(spark: SparkSession, root: str | None, excluded_dirs: Iterable[str] | None = None) -> DataFrame:
    """Media files below a folder, with kind, size and time of change; an unreadable root gives none.

    Directories are pruned while walking: the first two levels on the driver, each folder below them by
    a task. Files of no size, names with an underscore and upper-case extensions are found as well, which
    ``binaryFile`` would pass over.
    """
    empty = spark.createDataFrame([], SCHEMA)
    if not root or not root.strip() or not os.path.isdir(root):
        return empty
    names = set(excluded_dirs or ()) or set(EXCLUDED_DIRS)
    keep = lambda d: d not in names and not d.startswith(".")
    kinds = {f".{e}": kind for kind, exts in SCANNED.items() for e in exts}

    def files(folder: str, deep: bool) -> Iterator[tuple[str, str, int, datetime]]:
        for where, dirs, found in os.walk(folder):
            dirs[:] = [d for d in dirs if keep(d)] if deep else []
            for name in found:
                kind = kinds.get(os.path.splitext(name)[1].lower())
                if kind and not name.startswith("."):
                    full = os.path.join(where, name)
                    try:
                        stat = os.stat(full)
                    except OSError:
                        continue
                    yield full, kind, stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC).replace(tzinfo=None)

    folders: list[tuple[str, bool]] = [(root, False)]
    for d in sorted(os.listdir(root)):
        path = os.path.join(root, d)
        if os.path.isdir(path) and keep(d):
            folders.append((path, False))
            folders += [(os.path.join(path, x), True) for x in sorted(os.listdir(path)) if os.path.isdir(os.path.join(path, x)) and keep(x)]
    listed = spark.createDataFrame(folders, "folder string, deep boolean").repartition(max(1, min(len(folders), 64)))

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for folder, deep in zip(pdf["folder"], pdf["deep"]) for r in files(folder, deep)]
            yield pd.DataFrame(rows, columns=["file_path", "media_type", "file_size_bytes", "last_modified"])

    return listed.mapInPandas(walk, SCHEMA)


def provider_kind(path: Column) -> Column:
    """The kind by the extensions that metadata lookups know."""
    return kind_by_extension(extension(path), KNOWN)
