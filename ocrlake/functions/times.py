"""Instants written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339_instant(c: Column) -> Column:
    """The instant an RFC3339 string names, whatever its offset spelling; null where it is none.

    ``Z``, ``+00:00``, other offsets, lower-case ``t``/``z``, a blank instead of ``T`` and missing fractions
    all give the same instant. Fractions beyond microseconds are cut off.
    """
    text = F.upper(F.trim(c))
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})\s+(?=\d)", "$1T")
    return text.try_cast("timestamp")
