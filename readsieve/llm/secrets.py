"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

The base patterns give spans of kinds ``assign``, ``access`` and ``hex``. Loose tokens,
long runs that hold letters and digits and touch no base span, are candidates besides.
The value of every candidate is hashed, and over the whole corpus its distinct
repositories (documents) and owners (sources) are counted. A value is a widely copied
example if it is in ``REPOSITORIES_OF_EXAMPLES`` repositories or more, whoever owns them,
or if ``OWNERS_OF_EXAMPLES`` owners or more have it; else it looks live, also where a
document has a mirror under a second owner. Loose tokens that look live become spans of
kind ``owned``; base spans stay, whatever their frequency. The largest counts of a
document's candidates stand beside its spans.

Regular expressions give matches but no positions. A text split at a pattern gives the
gaps between the same matches, and sums over gaps and matches are the positions, in code
points. Only documents with a match have rows here, a row for a match.

Hot values are aggregated by owner and document first; joins carry narrow rows, never
texts. Null and empty texts have no spans. Repeated rows are scanned as rows of their own
and count as one document. A null source is an owner, and a null doc_id a document, of
its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readsieve.session import cut


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    least: int  # code points of the group


# The base kinds in order. A minimum that the run itself must reach stands
# in the pattern, which leaves the same matches; that of ``assign`` is tested afterwards,
# since a match that is too short still uses up its text.
BASE = [
    Kind(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
]
LOOSE = Kind("owned", r"[A-Za-z0-9_-]{20,}", 0, 20)
KINDS = [*BASE, LOOSE]
REPOSITORIES_OF_EXAMPLES = 5
OWNERS_OF_EXAMPLES = 3


def _matches(text: Column, kind: Kind) -> Column:
    """(gap before it, the match, its value) for each match, null if there is none."""
    gaps = F.split(text, kind.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else hits
    lengths = F.transform(F.slice(gaps, 1, F.size(hits)), F.length)
    found = F.arrays_zip(lengths.alias("gap"), F.transform(hits, F.length).alias("long"), values.alias("value"))
    return F.when(text.rlike(kind.pattern), found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, with a number of its own and its matches by kind."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "source",
        *[_matches(F.col("text"), k).alias(k.name) for k in KINDS],
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """(row, doc_id, source, kind, start, end, value) of base spans and loose tokens apart from them."""
    parts = None
    for number, kind in enumerate(KINDS):
        part = (
            scanned.where(F.col(kind.name).isNotNull())
            .select("row", "doc_id", "source", F.lit(number).alias("kind"), F.posexplode(kind.name).alias("i", "m"))
            .select("row", "doc_id", "source", "kind", "i", F.col("m.*"))
        )
        parts = part if parts is None else parts.unionByName(part)
    in_turn = Window.partitionBy("row", "kind").orderBy("i")
    ends = parts.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(in_turn))
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    loose = F.col("kind") == len(BASE)
    spans = (
        ends.withColumn("start", F.col("end") - F.col("long"))
        .where(F.length("value") >= least)
        .where(~loose | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    )
    # Loose tokens lie apart from a base span if none before ends later and none after begins earlier.
    # Both frames grow from their first row, so that each is one pass over the matches of a text.
    grown = (Window.unboundedPreceding, 0)
    forth = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(*grown)
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(*grown)
    passed = F.max(F.when(~loose, F.col("end"))).over(forth)
    coming = F.min(F.when(~loose, F.col("start"))).over(back)
    marked = spans.withColumn("passed", passed).withColumn("coming", coming)
    apart = (F.coalesce("passed", F.lit(0)) <= F.col("start")) & (F.coalesce("coming", F.col("end")) >= F.col("end"))
    return marked.where(~loose | apart).select("row", "doc_id", "source", "kind", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) of every candidate value in the corpus."""
    by_owner = found.groupBy("hash", "source", "doc_id").agg(F.lit(1).alias("one"))
    owned = by_owner.groupBy("hash", "source").agg(F.sum("one").alias("n"))
    return owned.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def find(docs: DataFrame) -> DataFrame:
    """Counts, spans and the standing of the candidates of every document."""
    scanned = cut(scan(docs), "scanned")
    found = cut(candidates(scanned).withColumn("hash", F.sha2("value", 256)).drop("value"), "candidates")
    owners = cut(ownership(found), "owners")
    live = (F.col("n_owners") < OWNERS_OF_EXAMPLES) & (F.col("n_repositories") < REPOSITORIES_OF_EXAMPLES)
    base = F.col("kind") < len(BASE)
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("text"))
    joined = found.join(owners, "hash")

    def listed(spans: Column) -> Column:
        ordered = F.transform(F.array_sort(spans), lambda s: s["text"])
        return F.concat_ws(",", ordered)

    per_row = joined.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k.name}") for i, k in enumerate(BASE)],
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(base | live, span)).alias("spans"),
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(~live, 1)).alias("n_examples"),
        F.max("n_repositories").alias("most_repositories"),
        F.max("n_owners").alias("most_owners"),
    )
    counts = [f"n_{k.name}" for k in BASE] + ["n_live", "n_examples", "most_repositories", "most_owners"]
    result = scanned.select("row", "doc_id").join(per_row, "row", "left")
    return result.select(
        "doc_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts[:3]],
        F.sha2(F.coalesce(listed(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("spans")), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts[3:]],
    )
