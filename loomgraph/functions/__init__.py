"""Scalar functions that the query language and the tools use, as columns."""

import hashlib
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def pad_start(text, width: int, fill: str = " ") -> Column:
    """``text`` padded on the left, never cut."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def literal_regex(text: str) -> str:
    """A regular expression that matches the text itself."""
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", text)


def iso_to_ms(text) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def ms_to_iso(ms) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def older_than(ms, now_ms: int, days: int) -> Column:
    return ms < F.lit(now_ms - days * 86_400_000)


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def shorten(text, most: int = 8000) -> Column:
    """Long texts cut, with a notice."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n… (truncated)"))).otherwise(text)


def root_hash(path: str) -> str:
    """The name of a root's own folder: eight hex digits of its canonical path's hash."""
    return hashlib.sha256(os.path.realpath(path).encode()).hexdigest()[:8]
