"""Theta sketches of hashes by group: distinct counts, unions and intersections within a stated error.

Beside the exact bottom-s sketches, for groups too large to be kept whole. A sketch has at most
``2^lg`` entries of 8 bytes whatever the group, and Spark builds it on the map side, so a group that
holds most rows costs no more than a small one. Sketches are columns: they can be stored, and merged later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 14
# Estimates are taken to hold within so many standard errors.
DEVIATIONS = 4.0


def sketch_of(hashes: DataFrame, keys: Sequence[str], *, hash_col: str = "hash", lg: int = LG) -> DataFrame:
    """``keys`` and ``theta``, the sketch of a group's hashes; NULL hashes are left out."""
    return hashes.groupBy(*keys).agg(F.theta_sketch_agg(F.col(hash_col), lg).alias("theta"))


def merged(sketches: DataFrame, keys: Sequence[str], *, lg: int = LG) -> DataFrame:
    """Sketches of finer groups, or of earlier runs, as those of ``keys``."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("theta", lg).alias("theta"))


def count(theta: Column) -> Column:
    return F.theta_sketch_estimate(theta)


def shared(a: Column, b: Column) -> Column:
    """Estimated number of hashes in both."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def either(a: Column, b: Column, lg: int = LG) -> Column:
    return F.theta_sketch_estimate(F.theta_union(a, b, lg))


def only(a: Column, b: Column) -> Column:
    """Estimated number of hashes in the first and not in the second."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def jaccard(a: Column, b: Column, lg: int = LG) -> Column:
    return shared(a, b) / F.nullif(either(a, b, lg), F.lit(0))


def error(part: Column, whole: Column, lg: int = LG) -> Column:
    """Stated error of the size of ``part``, a set out of the ``whole`` that the sketches span.

    Entries are a sample of ``whole`` at a rate of at least ``2^lg / whole``, so the size of a part has a
    variance of at most ``part * whole / 2^lg``; of a count itself, part and whole are the same.
    Sets below ``2^lg`` hashes are held whole and exact.
    """
    drawn = F.lit(DEVIATIONS) * F.sqrt(part.cast("double") * whole.cast("double") / F.lit(float(2**lg)))
    return F.when(whole <= 2**lg, F.lit(0.5)).otherwise(F.greatest(drawn, F.lit(DEVIATIONS) * whole / F.lit(float(2**lg))))
