"""Containment and Jaccard estimates from match counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kmer_count(length: Column, k: int) -> Column:
    """Number of k-windows of a sequence."""
    return length - F.lit(k) + F.lit(1)


def intersections(matches: Column, n_minima: Column, size: int, fp_rate: float, padding: bool) -> Column:
    """Matches, plus the empty slots where padding counts, less expected false positives.

    May fall below zero for a high ``fp_rate``; it is not clamped.
    """
    counted = matches + (F.lit(size) - n_minima) if padding else matches
    return (counted - F.lit(math.floor(fp_rate * size))).cast("long")


def containment(found: Column, size: int) -> Column:
    return found.cast("double") / F.lit(float(size))


def jaccard(length: Column, contained: Column, k: int, ref_length: int) -> Column:
    """Jaccard estimate; above 1 for a well-contained read longer than the reference."""
    query = kmer_count(length, k)
    part = query.cast("double") * contained
    return part / ((query + F.lit(ref_length - k + 1)).cast("double") - part)


def score(
    hits: DataFrame, *, k: int, size: int, fp_rate: float = 0.0, ref_length: int, padding: bool = False
) -> DataFrame:
    """``seq_len, n_minima, matches`` -> intersections, containment and Jaccard."""
    carried = [c for c in hits.columns if c != "matches"]
    found = hits.select(
        *carried,
        intersections(F.col("matches"), F.col("n_minima"), size, fp_rate, padding).alias("intersections"),
    )
    ratio = found.withColumn("containment", containment(F.col("intersections"), size))
    return ratio.withColumn("jaccard", jaccard(F.col("seq_len"), F.col("containment"), k, ref_length))
