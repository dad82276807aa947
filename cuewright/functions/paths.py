"""Column functions on paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that may surround a stored path.
QUOTES = "\"'`"


def clean_path(path: Column) -> Column:
    """The path without surrounding white space and quotes, in any order; null if nothing is left."""
    edge = rf"[\s {QUOTES}]+"
    return F.nullif(F.regexp_replace(path, rf"^{edge}|{edge}$", ""), F.lit(""))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")
