"""File names and file events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The event flags of the file monitor.
CREATED = 1 << 1
UPDATED = 1 << 2
REMOVED = 1 << 3
RENAMED = 1 << 4
IS_FILE = 1 << 9
IS_DIR = 1 << 10

READ_EXTENSIONS = ("fastq", "fq")


def extension(path: Column) -> Column:
    """Text after the last dot; empty without a dot, or if it leads the name."""
    before = F.length(path) - F.length(F.substring_index(path, ".", -1))
    return F.when(before > 1, F.substring_index(path, ".", -1)).otherwise(F.lit(""))


def is_read_file(path: Column) -> Column:
    return extension(path).isin(*READ_EXTENSIONS)


def has_flags(flags: Column, wanted: int) -> Column:
    return flags.bitwiseAND(F.lit(wanted)) == wanted


def event_kind(flags: Column) -> Column:
    """What the watcher makes of an event's combined flags."""
    return (
        F.when(has_flags(flags, CREATED | IS_FILE), F.lit("new_file"))
        .when(has_flags(flags, REMOVED), F.lit("deleted"))
        .otherwise(F.lit("modified"))
    )
