"""Packing documents into sequences by shortest-pack-first over the length histogram.

**Tokens.** A text is encoded word by word: words between ASCII white space never share
a token, so the ids of a text are those of its words in turn, and a task encodes each
word that it knows only once. Every document ends with ``end_id``.

**Cuts.** A document is cut into full pieces of ``capacity`` ids, each a sequence of its
own, and a rest. Only the histogram of the rests, at most ``capacity - 1`` numbers,
reaches the driver.

**Plan.** Lengths are placed from the longest to the shortest, each into the pack with
the most space left; packs that look alike are one pattern with a count, so the plan
grows with the number of lengths and not with the documents. Packs that end up with
space are then filled: the emptiest ones are poured, one after another, into the space of
the fullest ones. The last ids, fewer than a sequence, are cut into sequences whose
lengths are powers of two. So no sequence has padding, and only the poured documents are
cut once more.

**Ranks.** A rest has its rank among the rests of its length: its place within its
task's share plus the number in the shares before. Patterns name ranks, and the rests
of those ranks are their documents.

Null texts are empty: one piece with ``end_id``. Repeated rows and rows without a
doc_id are documents of their own. Texts of any length are encoded whole. Which of
several documents of one length takes a place depends on how the table is split; the
pieces of every document always cover it once. An empty table gives no rows. Columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from importlib import import_module
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType

from readsieve.llm.texts import batch_of, blocks, struct
from readsieve.session import cut

CAPACITY = 2_048
END_ID = 1
WORDS_KEPT = 1_500_000  # encoded words that a worker remembers; more are encoded again
LONG_WORD = 64  # bytes; longer words are not remembered
WORDS_TOGETHER = 20_000
TEXTS_TOGETHER = 1 << 21  # bytes
IDS_A_BATCH = 1 << 22
# Full pieces take sequence ids from here on, with room for so many in a task's share.
FULL_IDS = 1 << 40

_LONG, _INT, _BYTES = LongType(), IntegerType(), BinaryType()
ENCODED = struct(part=_LONG, doc_id=_LONG, doc_tokens=_LONG, rest=_INT, place=_LONG, full=_LONG, ids=_BYTES)
PIECES = struct(
    doc_id=_LONG, start=_LONG, length=_LONG, ids=_BYTES, doc_tokens=_LONG, sequence_id=_LONG, offset=_LONG
)


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """A tokenizer file as text, from any file system."""
    if "://" not in path:
        path = f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


class Words:
    """Ids of texts as bytes in little-endian order, word by word; a word is encoded when first met."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.known: dict[bytes, bytes] = {}

    def dtype(self, end_id: int) -> str:
        return "<u2" if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def _learn(self, words: list[bytes], dtype: str) -> None:
        """Encode words together and cut their ids apart at the places that they come from."""
        texts = [w.decode() for w in words]
        found = self.library.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.array([a for a, _ in found.offsets], np.int64)
        cuts = np.searchsorted(at, starts) * np.dtype(dtype).itemsize
        data, ends = np.array(found.ids, dtype).tobytes(), cuts.tolist()
        self.known.update(zip(words, (data[a:b] for a, b in zip(ends, ends[1:]))))

    def of(self, texts: list[bytes], dtype: str) -> list[bytes]:
        split = [text.split() for text in texts]
        met = set().union(*split)
        new = met.difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = met
        new = list(new)
        for i in range(0, len(new), WORDS_TOGETHER):
            self._learn(new[i : i + WORDS_TOGETHER], dtype)
        ids = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > LONG_WORD:
                del self.known[word]
        return ids

    def of_all(self, texts: Iterable[bytes], dtype: str) -> Iterator[bytes]:
        """The ids of each text; small texts go together, large ones in parts."""
        group, size = [], 0
        for text in texts:
            if len(text) > TEXTS_TOGETHER:
                yield from self.of(group, dtype)
                group, size = [], 0
                yield b"".join(self.of([part], dtype)[0] for part in blocks(text, TEXTS_TOGETHER))
                continue
            group.append(text)
            size += len(text)
            if size > TEXTS_TOGETHER:
                yield from self.of(group, dtype)
                group, size = [], 0
        yield from self.of(group, dtype)


_words: dict[str, Words] = {}


def words_of_worker(tokenizer: str) -> Words:
    """Kept from task to task."""
    if tokenizer not in _words:
        _words.clear()
        _words[tokenizer] = Words(tokenizer)
    return _words[tokenizer]


def encode(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The ids of every document and its place among the rests of its length in its task's share."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(ENCODED)
        # By its name, so that the worker's own copy of this module remembers.
        words = import_module(__name__).words_of_worker(tokenizer)
        dtype = words.dtype(end_id)
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        part, places, full, rows, held = TaskContext.get().partitionId(), Counter(), 0, [], 0
        for batch in batches:
            texts = (text.as_py() or b"" for text in batch.column(1).cast(pa.large_binary()))
            for doc_id, data in zip(batch.column(0).to_pylist(), words.of_all(texts, dtype)):
                data += end
                n = len(data) // width
                rest = n % capacity
                # The first byte tells the width of an id.
                rows.append((part, doc_id, n, rest, places[rest], full, dtype[-1:].encode() + data))
                places[rest] += 1
                full += n // capacity
                held += n
                if held >= IDS_A_BATCH:
                    yield batch_of(rows, schema)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(task, ENCODED)


# ------------------------------------------------------------------- the plan


@dataclass
class Packs:
    """``count`` packs that look alike: from each content (length, first rank) the i-th pack
    holds the rest with rank ``first rank + i``."""

    count: int
    space: int
    contents: list[tuple[int, int]]

    def split(self, n: int) -> tuple[Packs, Packs | None]:
        if n >= self.count:
            return self, None
        later = [(size, rank + n) for size, rank in self.contents]
        return Packs(n, self.space, self.contents), Packs(self.count - n, self.space, later)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Packs]:
    """Whole rests in packs, the fullest packs first."""
    full: list[Packs] = []
    turn = count()
    heap: list[tuple[int, int, Packs]] = []

    def push(packs: Packs | None) -> None:
        if packs and packs.space:
            heapq.heappush(heap, (-packs.space, next(turn), packs))
        elif packs:
            full.append(packs)

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            if heap and -heap[0][0] >= size:
                packs, others = heapq.heappop(heap)[2].split(left)
                push(others)
                push(Packs(packs.count, packs.space - size, [*packs.contents, (size, rank)]))
                rank, left = rank + packs.count, left - packs.count
                continue
            # None has room. A new pack is the shortest one as long as this length fits into
            # it, so each takes as many as fit; what doesn't come out even is a pack more.
            each = min(capacity // size, left)
            packs = left // each
            push(Packs(packs, capacity - each * size, [(size, rank + j * packs) for j in range(each)]))
            rank, left = rank + each * packs, left - each * packs
    return full + [packs for *_, packs in sorted(heap, key=lambda entry: (-entry[0], entry[1]))]


@dataclass(frozen=True)
class Poured:
    """``count`` stretches of ``length`` ids of the stream from ``start`` on: the i-th is at
    ``offset`` of ``sequence + i``."""

    start: int
    length: int
    count: int
    sequence: int
    offset: int


@dataclass
class Plan:
    """Where rests go. By length: first ranks, and from each on either (sequence, offset)
    of the rest that has it, or None, its place in the stream and the distance of the next."""

    ranks: dict[int, list[int]]
    places: dict[int, list[tuple[int | None, int, int]]]
    poured: list[Poured]

    def of(self, size: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the parts of a rest, in order."""
        i = bisect_right(self.ranks[size], rank) - 1
        sequence, at, apart = self.places[size][i]
        later = rank - self.ranks[size][i]
        if sequence is not None:
            return [(0, size, sequence + later, at)]
        at += later * apart
        parts, start = [], 0
        k = bisect_right(self.poured, at, key=lambda p: p.start) - 1
        while start < size:
            p = self.poured[k]
            j, into = divmod(at - p.start, p.length)
            if j == p.count:
                k += 1
                continue
            length = min(size - start, p.length - into)
            parts.append((start, length, p.sequence + j, p.offset + into))
            start, at = start + length, at + length
        return parts


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the rests go, for a histogram {length below the capacity: number}."""
    groups = shortest_pack_first({s: n for s, n in histogram.items() if s and n}, capacity)
    # All ids fill so many sequences: the fullest packs stay whole, the others are poured
    # into their space.
    stay = sum(packs.count * (capacity - packs.space) for packs in groups) // capacity
    places = defaultdict(list)
    poured: list[Poured] = []
    sequence = stream = room = 0
    for packs in groups:
        kept, others = packs.split(stay - sequence) if sequence < stay else (None, packs)
        if kept:
            offset = 0
            for size, rank in kept.contents:
                places[size].append((rank, (sequence, offset, 0)))
                offset += size
            if kept.space:
                poured.append(Poured(room, kept.space, kept.count, sequence, offset))
                room += kept.space * kept.count
            sequence += kept.count
        if others:
            filled, within = capacity - others.space, 0
            for size, rank in others.contents:
                places[size].append((rank, (None, stream + within, filled)))
                within += size
            stream += filled * others.count
    # What is left is less than a sequence: a sequence for each of its binary digits.
    while room < stream:
        length = 1 << ((stream - room).bit_length() - 1)
        poured.append(Poured(room, length, 1, sequence, 0))
        room, sequence = room + length, sequence + 1
    ordered = {size: sorted(own, key=lambda x: x[0]) for size, own in places.items()}
    return Plan({s: [r for r, _ in o] for s, o in ordered.items()}, {s: [x for _, x in o] for s, o in ordered.items()}, poured)


def _pieces(placed: Plan, capacity: int):
    names = ["part", "doc_id", "doc_tokens", "rest", "full", "rank", "ids"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(PIECES)
        rows, held = [], 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for part, doc_id, n, rest, full, rank, data in zip(*(c.to_pylist() for c in columns[:-1]), columns[-1]):
                data = data.as_py()
                ids = np.frombuffer(data, "<u" + data[:1].decode(), offset=1).astype("<u4")
                whole = n - rest
                first = FULL_IDS * (part + 1) + full
                found = [(i * capacity, capacity, first + i, 0) for i in range(whole // capacity)]
                if rest:
                    found += [(whole + start, length, seq, at) for start, length, seq, at in placed.of(rest, rank)]
                for start, length, seq, at in found:
                    rows.append((doc_id, start, length, ids[start : start + length].tobytes(), n, seq, at))
                held += n
                if held >= IDS_A_BATCH:
                    yield batch_of(rows, schema)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows, schema)

    return task, names


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset),
    ``ids`` as little-endian unsigned 32-bit numbers."""
    encoded = cut(encode(docs, tokenizer, capacity, end_id), "encoded")
    shares = encoded.where("rest > 0").groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"))
    shares = cut(shares, "shares")
    histogram = {r["rest"]: r["n"] for r in shares.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    task, names = _pieces(plan(histogram, capacity), capacity)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = shares.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = encoded.join(before, ["part", "rest"], "left").withColumn("rank", F.col("before") + F.col("place"))
    return ranked.select(*names).mapInArrow(task, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
