"""Kinds of media."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions.paths import base_name, extension, stem
from cuewright.functions.text import EPISODE_PATTERN, title_and_year

#: Extensions that a scan keeps, those that tell a kind of media, and those of videos to ingest.
SCANNED = {
    "video": ("mp4", "mkv", "mov", "avi", "webm", "m4v"),
    "audio": ("mp3", "wav", "aac", "flac", "m4a", "ogg"),
    "image": ("jpg", "jpeg", "png", "webp", "bmp", "tiff"),
}
KNOWN = {
    "video": ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm"),
    "audio": ("mp3", "aac", "flac", "wav", "ogg", "m4a"),
    "image": ("jpg", "jpeg", "png", "webp", "bmp", "tiff"),
}
INGESTED = ("mp4", "mkv", "avi", "mov", "webm")
#: Kinds of media that a hint may name.
KINDS = ("video", "audio", "image", "movie", "tv", "personal", "unknown")


def kind_by_extension(ext: Column, sets: dict[str, tuple[str, ...]] = SCANNED) -> Column:
    """The kind whose extensions hold ``ext`` (lower case, no dot), else null."""
    out = F.lit(None).cast("string")
    for kind, extensions in reversed(sets.items()):
        out = F.when(ext.isin(*extensions), kind).otherwise(out)
    return out


def checked_hint(hint: Column) -> Column:
    """The hint if it is exactly the name of a kind, else ``unknown``."""
    return F.when(hint.isin(*KINDS), hint).otherwise("unknown")


def media_kind(path: Column, hint: Column) -> Column:
    """The kind of a file: a hint that is not unknown; else tv by season and episode in the name, movie
    by a title and a year, video, audio or image by extension, else personal."""
    return kind_from(path, hint, title_and_year(stem(path)))


def kind_from(path: Column, hint: Column, parsed: Column) -> Column:
    """``media_kind`` of a file whose title and year (a struct) are known already."""
    by_extension = kind_by_extension(extension(path), KNOWN)
    guessed = (
        F.when(base_name(path).rlike(EPISODE_PATTERN), "tv")
        .when((parsed["title"] != "") & parsed["year"].isNotNull(), "movie")
        .otherwise(F.coalesce(by_extension, F.lit("personal")))
    )
    given = checked_hint(hint)
    return F.when(given != "unknown", given).otherwise(guessed)

