"""Identifiers of points."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(text: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """The name-based UUID (version 5) of a text, equal to Python's ``uuid.uuid5``; null for null."""
    raw = F.concat(F.unhex(F.lit(namespace.hex)), F.encode(text, "UTF-8"))
    h = F.substring(F.sha1(raw), 1, 32)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def number_text(value: Column) -> Column:
    """A double as Python prints it; the JVM agrees from 0.001 to below ten million, and for zero."""
    plain = ((F.abs(value) >= 1e-3) & (F.abs(value) < 1e7)) | (value == 0)
    exact = F.regexp_replace(F.call_function("format_number", value, F.lit("0.################")), r"^(-?[0-9]+)$", "$1.0")
    return F.when(plain, value.cast("string")).when(F.abs(value) < 1e16, exact).otherwise(value.cast("string"))


def segment_key(path: Column, start: Column) -> Column:
    """Key text of a dialogue segment: path and start as written."""
    return F.concat(path, F.lit("_"), number_text(start))


def frame_key(path: Column, timestamp: Column) -> Column:
    """Key text of a frame: path and time with three decimals."""
    return F.concat(path, F.lit("_"), F.call_function("format_number", timestamp, F.lit("0.000")))


def random_id() -> Column:
    """A random UUID (version 4); assign it once and store it, as it differs each time."""
    return F.uuid()


def face_cache_key(image: Column, box: Column, version: Column | str) -> Column:
    """Hash of an image, a box and a model version, under which a face's vector is kept."""
    sides = F.concat_ws(",", *[box[c].cast("string") for c in ("top", "right", "bottom", "left")])
    version = F.lit(version) if isinstance(version, str) else version
    return F.sha1(F.concat(image.cast("binary"), F.encode(sides, "UTF-8"), F.encode(version, "UTF-8")))
