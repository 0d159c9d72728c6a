"""Every operator as a query over the given tables.

``documents`` are the reads and ``benchmark`` the whitelist, with prose read
through the text alphabet. Each function takes the session and a folder of
parquet tables and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.functions import files, json_spans, jsons
from readsieve.functions.bases import TEXT, reverse_complement, to_bases
from readsieve.functions.hashing import canonical_kmer, hash64, kmer_code, tag
from readsieve.functions.kmers import kmer_rows, valid_windows
from readsieve.operators import blocked, bloom, overlap, sketch, theta
from readsieve.operators.blocked import BlockedParams
from readsieve.operators.bloom import BloomParams
from readsieve.operators.containment import kmer_count
from readsieve.operators.emission import KmerSpec
from readsieve.plans.screen import ScreenSpec, prepare, quarantine, screen
from readsieve.plans.whitelist import kept
from readsieve.session import cut, deal, fresh_path
from readsieve.sources.blocks import write_blocked
from readsieve.sources.fastx import FOUR_LINE, create, parse, read_fastx, render_fastq
from readsieve.sources.fastx_source import register
from readsieve.sources.tables import columns_of, table
from readsieve.streaming.watch import metrics, watch

SIZE = 128
LEAST_SHARED = 96
# Default filter capacity and error rate, and the fixed reference length.
FILTER = BloomParams.of(100_000, 0.001)
FIXED_REF_LENGTH = 18_246
# A filter far too small for the whitelist, so that it does err.
SMALL_FILTER = BloomParams.of(1_000, 0.05)
SMALL_BLOCKED = BlockedParams.of(1_000, 0.05)
# Sketches smaller than most sources' sets of hashes, so that they estimate.
THETA_LG = 9

Query = Callable[[SparkSession, str], DataFrame]


def _spec(k: int, compat: bool = True) -> KmerSpec:
    return KmerSpec(k, compat, TEXT)


def _documents(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return columns_of(spark, sf, "documents", "doc_id", "text", *extra)


def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", "text")


def _events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return deal(table(spark, sf, "events").select("event_id", *columns))


# ------------------------------------------------------------ bases and k-mers


def base_composition(spark: SparkSession, sf: str) -> DataFrame:
    counts = sketch.base_counts(_documents(spark, sf, "lang"), TEXT, id_cols=["lang"], seq_col="text")
    return counts.groupBy("lang").agg(*[F.sum(c).alias(c) for c in counts.columns[1:]])


def reverse_complements(spark: SparkSession, sf: str) -> DataFrame:
    turned = reverse_complement(to_bases(F.col("text")))
    return _documents(spark, sf).select("doc_id", F.md5(turned).alias("rc_md5"))


def kmer_windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).where(F.length("text") >= 7)
    return docs.select(
        "doc_id",
        kmer_count(F.length("text"), 7).cast("long").alias("n_windows"),
        valid_windows(F.col("text"), 7, TEXT).alias("n_valid"),
    )


def canonical_kmers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct canonical k-mers of all documents, as built-in expressions throughout.

    K-mers are made distinct before they are turned round, which leaves few to turn.
    """
    found = kmer_rows(_documents(spark, sf), 7, TEXT, seq_col="text").distinct()
    distinct = found.select(canonical_kmer(F.col("kmer")).alias("kmer")).distinct()
    return distinct.select(kmer_code(F.col("kmer")).alias("canonical"))


def hashed_kmers(k: int) -> Query:
    """The same from the Arrow tasks, with the hash worked out on the distinct codes."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        codes = sketch.canonical_codes(_documents(spark, sf), k, TEXT, seq_col="text")
        return codes.select("canonical", tag(hash64(F.col("canonical"), k), k).alias("hash"))

    return run


# ------------------------------------------------------------------- sketches


def emitted_hashes(k: int, compat: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = sketch.emitted(_documents(spark, sf), _spec(k, compat), id_cols=["doc_id"], seq_col="text")
        return found.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n_hashes"), F.max("hash").alias("max_hash"), F.sum("hash").alias("sum_hash")
        )

    return run


def _sketches(spark: SparkSession, sf: str, k: int, compat: bool, *extra: str) -> DataFrame:
    docs = _documents(spark, sf, *extra)
    return sketch.sketch(docs, _spec(k, compat), SIZE, id_cols=["doc_id", *extra], seq_col="text")


def sketch_summary(k: int, compat: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        total = F.aggregate("minima", F.lit(0).cast("long"), lambda acc, h: acc + h)
        return _sketches(spark, sf, k, compat).select(
            "doc_id",
            "seq_len",
            F.col("n_minima").cast("long").alias("n_minima"),
            F.array_max("minima").alias("largest"),
            F.array_min("minima").alias("smallest"),
            total.alias("total"),
        )

    return run


def sketch_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = sketch.minima_rows(_sketches(spark, sf, 7, True), id_cols=["doc_id"])
    return rows.select("doc_id", F.col("rank").cast("long").alias("rank"), "hash")


def sketch_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its class of equal sketches and the number of sketches that share three quarters of theirs or more."""
    return overlap.links(_sketches(spark, sf, 7, True), LEAST_SHARED, id_col="doc_id")


def sketch_by_source(k: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        merged = sketch.merge(_sketches(spark, sf, k, True, "source"), _spec(k), SIZE, keys=["source"])
        return merged.select("source", F.posexplode("minima").alias("rank", "hash")).withColumn(
            "rank", F.col("rank").cast("long")
        )

    return run


def whitelist_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.distinct_hashes(_benchmark(spark, sf), _spec(7), seq_col="text")


def whitelist_grown(spark: SparkSession, sf: str) -> DataFrame:
    """The whitelist in two parts, the second merged into the kept store of the first: each hash and the version it came with."""
    path, items = fresh_path(spark, "whitelist"), _benchmark(spark, sf)
    with kept(spark, path, _spec(7), FILTER) as store:
        store.grow(items.where("item_id % 2 = 0"), seq_col="text")
    with kept(spark, path, _spec(7), FILTER) as store:
        store.grow(items.where("item_id % 2 = 1"), seq_col="text")
        return cut(store.hashes().select("hash", F.col("version").cast("long").alias("version")), "grown")


def theta_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of each source, those it shares with the whitelist, and whether Theta sketches say the same within their error."""
    docs = _documents(spark, sf, "source")
    pairs = cut(sketch.grouped_hashes(docs, _spec(7), keys=["source"], seq_col="text"), "pairs")
    white = cut(sketch.distinct_hashes(_benchmark(spark, sf), _spec(7), seq_col="text"), "white")
    marked = pairs.join(white.withColumn("held", F.lit(1)), "hash", "left")
    exact = marked.groupBy("source").agg(F.count(F.lit(1)).alias("n_hashes"), F.count("held").alias("n_shared"))
    n_white = white.count()
    other = F.lit(bytes(theta.sketch_of(white, [], lg=THETA_LG).first()["theta"]))
    mine = F.col("theta")
    found = exact.join(
        theta.sketch_of(pairs, ["source"], lg=THETA_LG).withColumnRenamed("source", "named"), F.expr("source <=> named")
    )
    whole = F.col("n_hashes") + F.lit(n_white) - F.col("n_shared")
    wanted = {
        "count_within": (theta.count(mine), F.col("n_hashes"), F.col("n_hashes")),
        "shared_within": (theta.shared(mine, other), F.col("n_shared"), whole),
        "either_within": (theta.either(mine, other, THETA_LG), whole, whole),
        "only_within": (theta.only(mine, other), F.col("n_hashes") - F.col("n_shared"), whole),
    }
    within = [(F.abs(e - part) <= theta.error(part, all_, THETA_LG)).alias(n) for n, (e, part, all_) in wanted.items()]
    return found.select("source", "n_hashes", "n_shared", *within)


# -------------------------------------------------------------- Bloom filters


def bloom_sizing(spark: SparkSession, sf: str) -> DataFrame:
    """Filters sized to hold every character position of a source's documents."""
    capacity = table(spark, sf, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("entries"))
    columns = bloom.params_columns(F.col("entries"), 0.001)
    columns["bpe"] = F.round(columns["bpe"], 9)
    return capacity.select("source", "entries", *[c.alias(n) for n, c in columns.items()])


def murmur_keys(spark: SparkSession, sf: str) -> DataFrame:
    a, b = bloom.key_hashes(F.col("hash"), 7)
    return whitelist_hashes(spark, sf).select("hash", a.alias("hash_a"), b.alias("hash_b"))


def bloom_positions(spark: SparkSession, sf: str) -> DataFrame:
    return bloom.with_positions(whitelist_hashes(spark, sf), FILTER, 7)


def bloom_words(spark: SparkSession, sf: str) -> DataFrame:
    return bloom.bit_words(whitelist_hashes(spark, sf), FILTER, 7)


def bloom_members(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of all documents that the small filter holds, false positives included."""
    words = bloom.bit_words(whitelist_hashes(spark, sf), SMALL_FILTER, 7)
    asked = sketch.distinct_hashes(_documents(spark, sf), _spec(7), seq_col="text")
    return bloom.members(asked, words, SMALL_FILTER, 7)


def bloom_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of all documents that a small blocked filter holds, and whether the whitelist really has them."""
    white = whitelist_hashes(spark, sf)
    filled = blocked.blocks_of(white, SMALL_BLOCKED, 7)
    asked = sketch.distinct_hashes(_documents(spark, sf), _spec(7), seq_col="text")
    found = blocked.members(asked, filled, SMALL_BLOCKED, 7)
    held = white.select("hash", F.lit(True).alias("held"))
    return found.join(held, "hash", "left").select("hash", F.coalesce("held", F.lit(False)).alias("in_whitelist"))


# ---------------------------------------------------------------- containment


def screening(spec: ScreenSpec) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepared = prepare(_benchmark(spark, sf), spec, seq_col="text")
        found = screen(_documents(spark, sf), prepared, spec, id_cols=["doc_id"], seq_col="text")
        return found.withColumn("n_minima", F.col("n_minima").cast("long"))

    return run


def quarantined_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that ``containment`` has no row for, and why."""
    return quarantine(_documents(spark, sf), SCREENS["containment"], id_cols=["doc_id"], seq_col="text")


SCREENS = {
    "containment": ScreenSpec(_spec(7, False), SIZE),
    "containment_compat": ScreenSpec(_spec(7, True), SIZE),
    "containment_fixed_reference": ScreenSpec(_spec(7, True), SIZE, ref_length=FIXED_REF_LENGTH),
    "containment_joined": ScreenSpec(_spec(7, True), SIZE, broadcast_values=0),
    "containment_k15": ScreenSpec(_spec(15, True), SIZE),
    "containment_k5": ScreenSpec(_spec(5, True), 64),
    "bloom_containment": ScreenSpec(_spec(7, False), SIZE, filter=FILTER, fp_rate=0.001),
    "bloom_containment_compat": ScreenSpec(_spec(7, True), SIZE, filter=FILTER, fp_rate=0.02),
    "bloom_containment_joined": ScreenSpec(_spec(7, True), SIZE, filter=SMALL_FILTER, fp_rate=0.05, broadcast_bytes=0),
    "bloom_containment_small": ScreenSpec(_spec(7, True), SIZE, filter=SMALL_FILTER, fp_rate=0.05),
}


# --------------------------------------------------------------- FASTA/FASTQ


def _as_fastq(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "source")
    bases = to_bases(F.col("text"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", name.alias("name"), F.col("source").alias("comment"), bases.alias("seq"))


def _record_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "name",
        "comment",
        F.length("seq").cast("long").alias("seq_len"),
        F.md5("seq").alias("seq_md5"),
        F.length("qual").cast("long").alias("qual_len"),
        "status",
    )


def fastx_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a FASTQ record followed by a FASTA record, read back."""
    seq = F.col("seq")
    fasta = F.concat(F.lit(">"), F.col("name"), F.lit("\n"), seq, F.lit("\r\n"))
    both = F.concat(render_fastq(F.col("name"), F.col("comment"), seq), F.lit("\n"), fasta)
    contents = _as_fastq(spark, sf).select(F.col("name").alias("path"), F.encode(both, "UTF-8").alias("content"))
    return _record_columns(parse(contents))


def fastx_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records whose quality is whole, one character short, or missing; a good record follows."""
    seq, name, comment = F.col("seq"), F.col("name"), F.col("comment")
    kind = F.col("doc_id") % 3
    qual = F.repeat(F.lit("I"), F.length(seq).cast("int"))
    line = F.when(kind == 0, F.concat(qual, F.lit("\n"))).when(kind == 1, F.concat(F.substring(qual, 2, 1 << 30), F.lit("\n")))
    damaged = F.concat(F.lit("@"), name, F.lit(" "), comment, F.lit("\n"), seq, F.lit("\n+\n"), F.coalesce(line, F.lit("")))
    both = F.concat(damaged, render_fastq(F.concat(name, F.lit("b")), comment, F.lit("acgt")))
    contents = _as_fastq(spark, sf).select(name.alias("path"), F.encode(both, "UTF-8").alias("content"))
    return _record_columns(parse(contents, layout=FOUR_LINE))


def _write_fastq(spark: SparkSession, sf: str) -> str:
    folder = fresh_path(spark, "fastq")
    record = render_fastq(F.col("name"), F.col("comment"), F.col("seq"))
    _as_fastq(spark, sf).select(record.alias("value")).write.text(folder)
    return folder


def fastx_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as FASTQ files on disk, read in byte ranges."""
    folder = _write_fastq(spark, sf)
    found = read_fastx(spark, folder, glob="*.txt", layout=FOUR_LINE, content_bytes=0, split_bytes=1 << 20)
    return _record_columns(found)


def fastx_gzip(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as blocked gzip files, cut at their members and read in parallel."""
    record = render_fastq(F.col("name"), F.col("comment"), F.col("seq"))
    files = write_blocked(_as_fastq(spark, sf), record, fresh_path(spark, "blocked"), create)
    return _record_columns(read_fastx(spark, files, content_bytes=0, split_bytes=1 << 16))


def fastx_source(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as FASTQ files, read through the registered format."""
    register(spark)
    reader = spark.read.format("fastx").option("glob", "*.txt").option("layout", FOUR_LINE).option("splitBytes", 1 << 20)
    return _record_columns(reader.load(_write_fastq(spark, sf)))


# The same for the documents' text and, with it turned to bases, for the files.
WATCH_SPEC = ScreenSpec(_spec(7), SIZE, filter=FILTER, fp_rate=0.001)


def _watched(spark: SparkSession, sf: str) -> str:
    """The folder of results of a watch that has worked off the documents as FASTQ files."""
    folder = _write_fastq(spark, sf)
    spec = replace(WATCH_SPEC, kmers=KmerSpec(7, True))
    whitelist = _benchmark(spark, sf).select("item_id", to_bases(F.col("text")).alias("seq"))
    out = fresh_path(spark, "watched")
    query = watch(
        spark,
        folder,
        prepare(whitelist, spec),
        spec,
        out=out,
        checkpoint=fresh_path(spark, "watch-log"),
        include_existing=True,
        glob="*.txt",
        drain=True,
    )
    query.awaitTermination()
    return out


def watched_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same files screened by the directory watch as a stream."""
    return (
        spark.read.parquet(_watched(spark, sf))
        .drop("file", "record_offset", "batch")
        .withColumn("n_minima", F.col("n_minima").cast("long"))
    )


def watch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What the watch counted while it ran, over all batches."""
    sums = [F.sum(c).alias(c) for c in ("reads", "bases", "hits", "quarantined")]
    return metrics(spark, _watched(spark, sf)).agg(*sums)


# ------------------------------------------------------------ files and events


def file_extensions(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    ext = files.extension(F.col("url"))
    return pages.select("page_id", ext.alias("extension"), files.is_read_file(F.col("url")).alias("is_read_file"))


def _event_flag(kind: Column) -> Column:
    """Event types standing in for the flags of the file monitor."""
    return (
        F.when(kind == "signup", F.lit(files.CREATED))
        .when(kind == "purchase", F.lit(files.IS_FILE))
        .when(kind == "error", F.lit(files.REMOVED))
        .otherwise(F.lit(files.UPDATED))
    )


def event_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags combined over batches of eight events, and what the watcher makes of them."""
    events = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 8).alias("batch"), _event_flag(F.col("event_type")).cast("long").alias("flag")
    )
    combined = events.groupBy("batch").agg(F.bit_or("flag").alias("flags"))
    return combined.withColumn("kind", files.event_kind(F.col("flags")))


# ----------------------------------------------------------------------- JSON


def _event_json(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit('{"id": '),
        F.col("event_id").cast("string"),
        F.lit(', "type": "'),
        F.col("event_type"),
        F.lit('", "user": ['),
        F.col("user_id").cast("string"),
        F.lit(', "0x'),
        F.lower(F.hex("user_id")),
        F.lit('", {"odd": '),
        (F.col("user_id") % 2 == 1).cast("string"),
        F.lit('}], "props": '),
        F.col("props"),
        F.lit("}"),
    )
    return _events(spark, sf, "event_type", "user_id", "props").select("event_id", text.alias("json"))


def json_scan(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {
        "id": (".id", "%ld"),
        "type": (".type", "%Q"),
        "user": (".user[0]", "%d"),
        "user_hex": (".user[1]", "%d"),
        "odd": (".user[2].odd", "%B"),
        "k": (".props.k", "%ld"),
        "user_json": (".user", "%T"),
        "missing": (".none", "%Q"),
    }
    columns = jsons.scan(F.col("json"), wanted)
    for name in ("user", "user_hex", "scanned"):
        columns[name] = columns[name].cast("long")
    return _event_json(spark, sf).select("event_id", *[c.alias(n) for n, c in columns.items()])


def json_walk(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _event_json(spark, sf).select("event_id", F.explode(jsons.walk(F.col("json"))).alias("n"))
    return nodes.select("event_id", "n.path", "n.name", "n.type", F.md5("n.value").alias("value_md5"))


def json_set(spark: SparkSession, sf: str) -> DataFrame:
    props, added = F.col("props"), F.col("event_type")
    return _events(spark, sf, "event_type", "props").select(
        "event_id",
        jsons.set_path(props, ".k", F.lit("7")).alias("replaced"),
        jsons.set_path(props, ".t", jsons.quoted(added)).alias("added"),
        jsons.set_path(props, ".a.b", F.lit("[1]")).alias("nested"),
        jsons.set_path(jsons.set_path(props, ".l", F.lit("[1]")), ".l[]", F.lit("2")).alias("appended"),
        jsons.set_path(props, ".k", None).alias("deleted"),
        jsons.set_path(jsons.set_path(props, ".l", F.lit("[1,2,3]")), ".l[1]", None).alias("removed"),
    )


def json_entries(spark: SparkSession, sf: str) -> DataFrame:
    found = _event_json(spark, sf).select("event_id", F.posexplode(jsons.entries(F.col("json"))).alias("ord", "e"))
    return found.select("event_id", F.col("ord").cast("long").alias("ord"), "e.key", "e.value")


def json_elements(spark: SparkSession, sf: str) -> DataFrame:
    found = _event_json(spark, sf).select("event_id", F.explode(jsons.elements(F.col("json"), ".user")).alias("e"))
    return found.select("event_id", F.col("e.idx").cast("long").alias("idx"), "e.value")


def json_element(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("json")
    return _event_json(spark, sf).select("event_id", jsons.array_element(text, ".user", 2).alias("value"))


def json_pretty(spark: SparkSession, sf: str) -> DataFrame:
    return _event_json(spark, sf).select("event_id", jsons.prettify(F.col("json")).alias("pretty"))


def json_print(spark: SparkSession, sf: str) -> DataFrame:
    printed = jsons.print_object(
        id=F.col("event_id"), type=F.col("event_type"), none=F.lit(None).cast("string"), odd=F.col("user_id") % 2 == 1
    )
    array = jsons.print_array(F.array(F.col("event_id"), F.col("user_id")))
    return table(spark, sf, "events").select("event_id", printed.alias("object"), array.alias("array"))


def json_escape(spark: SparkSession, sf: str) -> DataFrame:
    escaped = jsons.escape(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.md5(escaped).alias("escaped_md5"), escaped.alias("e")).select(
        "doc_id", "escaped_md5", F.md5(jsons.unescape(F.col("e"))).alias("back_md5")
    )


def json_binary(spark: SparkSession, sf: str) -> DataFrame:
    data = F.encode(F.col("text"), "UTF-8")
    return _documents(spark, sf).select(
        "doc_id", F.md5(jsons.hex_string(data)).alias("hex_md5"), F.md5(jsons.base64_string(data)).alias("base64_md5")
    )


def json_offsets(spark: SparkSession, sf: str) -> DataFrame:
    found = _event_json(spark, sf).select("event_id", F.explode(json_spans.spans(F.col("json"))).alias("s"))
    at, length = F.col("s.at").cast("long"), F.col("s.length").cast("long")
    return found.select("event_id", "s.path", "s.name", "s.type", at.alias("at"), length.alias("length"))


def json_splice(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("json")
    return _event_json(spark, sf).select(
        "event_id",
        json_spans.splice(text, ".user[2].odd", F.lit("null")).alias("replaced"),
        json_spans.splice(text, ".props.t.u", F.lit("[1]")).alias("added"),
        json_spans.splice(text, ".user[]", F.col("event_id").cast("string")).alias("appended"),
        json_spans.splice(text, ".user[0]", None).alias("removed"),
        json_spans.splice(text, ".type", None).alias("deleted"),
    )


def json_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose keys are bare: scanned, walked, set, and changed in place."""
    keys = F.regexp_replace(F.col("json"), '"(id|type|user|odd|props|k)":', "$1:")
    quoted = json_spans.quote_keys(F.col("bare"))
    return _event_json(spark, sf).select("event_id", keys.alias("bare")).select(
        "event_id",
        jsons.scalar(quoted, ".type").alias("type"),
        jsons.token(quoted, ".user").alias("user_json"),
        F.array_join(F.transform(jsons.walk(quoted), lambda n: n["path"]), " ").alias("paths"),
        jsons.set_path(jsons.token(quoted, ".props"), ".k", F.lit("7")).alias("changed"),
        json_spans.splice(F.col("bare"), ".props.k", F.lit("7")).alias("spliced"),
    )


QUERIES: dict[str, Query] = {
    "base_composition": base_composition,
    "reverse_complements": reverse_complements,
    "kmer_windows": kmer_windows,
    "canonical_kmers": canonical_kmers,
    "hash64_k5": hashed_kmers(5),
    "hash64_k7": hashed_kmers(7),
    "hash64_k15": hashed_kmers(15),
    "emitted_hashes": emitted_hashes(7, True),
    "emitted_hashes_k5": emitted_hashes(5, True),
    "emitted_hashes_plain": emitted_hashes(7, False),
    "sketch_summary": sketch_summary(7, True),
    "sketch_summary_plain": sketch_summary(7, False),
    "sketch_summary_k15": sketch_summary(15, True),
    "sketch_summary_even_k": sketch_summary(8, True),
    "sketch_rows": sketch_rows,
    "sketch_overlaps": sketch_overlaps,
    "sketch_by_source": sketch_by_source(7),
    "sketch_by_source_k15": sketch_by_source(15),
    "theta_by_source": theta_by_source,
    "whitelist_hashes": whitelist_hashes,
    "whitelist_grown": whitelist_grown,
    "bloom_sizing": bloom_sizing,
    "murmur_keys": murmur_keys,
    "bloom_positions": bloom_positions,
    "bloom_words": bloom_words,
    "bloom_members": bloom_members,
    "bloom_blocked": bloom_blocked,
    **{name: screening(spec) for name, spec in SCREENS.items()},
    "quarantined_reads": quarantined_reads,
    "fastx_records": fastx_records,
    "fastx_damaged": fastx_damaged,
    "fastx_files": fastx_files,
    "fastx_gzip": fastx_gzip,
    "fastx_source": fastx_source,
    "watched_files": watched_files,
    "watch_metrics": watch_metrics,
    "file_extensions": file_extensions,
    "event_flags": event_flags,
    "json_scan": json_scan,
    "json_walk": json_walk,
    "json_set": json_set,
    "json_entries": json_entries,
    "json_elements": json_elements,
    "json_element": json_element,
    "json_pretty": json_pretty,
    "json_print": json_print,
    "json_escape": json_escape,
    "json_binary": json_binary,
    "json_offsets": json_offsets,
    "json_splice": json_splice,
    "json_lenient": json_lenient,
}
