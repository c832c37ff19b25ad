"""Number and name formats used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size suffixes, base 1024.
SIZE_SUFFIXES = ("B", "KB", "MB", "GB", "TB", "PB", "EB")


def human_readable_size(size: Column) -> Column:
    """``1536`` as ``1.50 KB``; thousands separators below EB."""
    value = size.cast("double")
    last = len(SIZE_SUFFIXES) - 1
    text = F.format_string(f"%.2f {SIZE_SUFFIXES[last]}", value / float(1024**last))
    for power in reversed(range(last)):
        shown = F.format_string(f"%,.2f {SIZE_SUFFIXES[power]}", value / float(1024**power))
        text = F.when(value < float(1024 ** (power + 1)), shown).otherwise(text)
    return text


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def chunk_name(chunk_id: Column) -> Column:
    return F.format_string("chunk_%04d", chunk_id)
