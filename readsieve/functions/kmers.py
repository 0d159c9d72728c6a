"""K-mers as built-in expressions, for plans that want them as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsieve.functions.bases import runs, spell


def valid_windows(seq: Column, k: int, alphabet: str) -> Column:
    """Number of k-windows without an ambiguous character."""
    sizes = F.transform(runs(seq, alphabet, k), lambda r: (F.length(r) - F.lit(k - 1)).cast("long"))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, n: acc + n)


def kmer_rows(seqs: DataFrame, k: int, alphabet: str, *, seq_col: str = "seq") -> DataFrame:
    """One row (``kmer``, lower-case) per complete window of a sequence column.

    Only runs of k or more bases are spelled out. Windows are cut from the bytes
    rather than the characters: a byte slice is found at once, where a character
    slice counts its way from the start of the string.
    """
    pieces = seqs.select(F.explode(runs(F.col(seq_col), alphabet, k)).alias("run"))
    raw = pieces.select(spell(F.col("run"), alphabet).cast("binary").alias("raw"))
    starts = F.sequence(F.lit(1), F.length("raw") - F.lit(k - 1))
    windows = raw.select("raw", F.explode(starts).alias("at"))
    return windows.select(F.substring("raw", F.col("at"), F.lit(k)).cast("string").alias("kmer"))
