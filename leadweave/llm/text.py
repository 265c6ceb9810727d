"""Word columns of the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; empty for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
