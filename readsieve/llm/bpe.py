"""Byte-level BPE encoding and decoding with a rank file.

The bytes of the vocabulary are mapped to Latin-1 characters for an Aho-Corasick
automaton, which finds the longest token at every position of a piece in one pass.
Encoding walks from longest match to longest match; a token is taken only if it is
compatible with the one before it, meaning that the merges leave exactly these two
tokens when they start from their joined bytes. If none fits, the walk steps back
and marks the position, so each position is given up once at most and a piece is
encoded in linear time. A sequence in which all neighbours are compatible is the
one that the merges produce. Compatibility is remembered for pairs of tokens.

Null texts count as empty: no ids. Texts of any length are encoded in blocks cut
where white space follows something else, which is a border of pieces anyway.
Repeated rows are encoded alike; only the named columns of the input are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from readsieve.llm.texts import per_row

CUT_CHARS = 1 << 18
PIECES_KEPT = 100_000
PAIRS_KEPT = 200_000
_NEVER = 1 << 62
LONG_PIECE = 64

DIGEST_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank, one token a line."""
    if "://" not in path:
        path = f"file://{path}"
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Bpe:
    """Encoder and decoder for one vocabulary and one pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, unreachable: frozenset[bytes] | None = None):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        # A token that its own bytes don't merge into stands for a whole piece only.
        self.unreachable = self._unreachable() if unreachable is None else unreachable
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            if token not in self.unreachable:
                self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern)
        self.border = regex.compile(r"(?<=\S)\s")
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.prefixes: dict[bytes, int] = {}
        self.memo = _Memo(self)

    def _unreachable(self) -> frozenset[bytes]:
        return frozenset(t for t, rank in self.ranks.items() if len(t) > 1 and self.merged(t) != [rank])

    def merged(self, data: bytes) -> list[int]:
        """The merges as defined: lowest rank first, leftmost first. Only for short bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((r for r in found if r is not None), default=None)
            if least is None:
                break
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of a token while it is merged, from its outermost byte up to
        the token itself, each with the rank at which the next one takes its place."""
        known = self.spines[side].get(token)
        if known is None:
            whole, known = self.tokens[token], []
            at, rank = whole, _NEVER
            while True:
                known.append((at, rank))
                if len(at) == 1:
                    break
                rank = self.ranks[at]
                at = self._halves(at)[side]
            known.reverse()
            self.spines[side][token] = known
        return known

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joins."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            i = found.index(min(found))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges of the joined bytes leave these two tokens?

        They do unless some part at the end of the left one and some part at the start of
        the right one stand side by side and merge before either is merged into its own
        token. Of equal merges the one further left comes first.
        """
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            ends, starts = self._spine(left, 1), self._spine(right, 0)
            i = j = 0
            known = True
            while True:
                (x, x_until), (y, y_until) = ends[i], starts[j]
                rank = self.ranks.get(x + y, _NEVER)
                if rank < x_until and rank <= y_until and rank != _NEVER:
                    known = False
                    break
                if x_until == y_until == _NEVER:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.pairs[left << 32 | right] = known
        return known

    def shorter(self, token: bytes) -> int:
        """Length of the longest token that begins ``token``, itself left out; 0 if none."""
        known = self.prefixes.get(token)
        if known is None:
            known = len(token) - 1
            while known and (token[:known] not in self.ranks or token[:known] in self.unreachable):
                known -= 1
            self.prefixes[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [1] * n
        for end, size in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = size
        ranks, pairs, compatible = self.ranks, self.pairs, self.compatible
        refused: set[int] = set()
        ids: list[int] = []
        at, size, last = 0, longest[0], -1
        while at < n:
            while size:
                if at + size not in refused:
                    token = ranks[piece[at : at + size]]
                    if last < 0 or pairs.get(last << 32 | token) or compatible(last, token):
                        break
                size = self.shorter(piece[at : at + size])
            if size:
                ids.append(token)
                last = token
                at += size
                size = longest[at] if at < n else 0
            elif ids:
                refused.add(at)
                size = len(self.tokens[ids.pop()])
                at -= size
                last = ids[-1] if ids else -1
            else:
                raise ValueError(f"no tokens for {piece!r}")
        return ids

    def packed(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, a block at a time."""
        start, get = 0, self.memo.__getitem__
        while start < len(text):
            end = len(text)
            if end - start > CUT_CHARS and (border := self.border.search(text, start + CUT_CHARS)):
                end = border.start()
            part = text if end - start == len(text) else text[start:end]
            yield b"".join(map(get, self.pieces.findall(part)))
            start = end

    def encode(self, text: str) -> list[int]:
        return [i for block in self.packed(text) for i in np.frombuffer(block, "<u4").tolist()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """Packed ids of pieces seen before: when full, it becomes the old one and starts anew,
    and what is asked for again comes back from there."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = _packed(self.bpe.encode_piece(piece.encode()))
        if len(piece) <= LONG_PIECE:
            if len(self) >= PIECES_KEPT:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


# The coder of the latest run in this process: tasks that follow find its memory filled.
_LATEST: dict[str, Bpe] = {}


def _coder(key: str, ranks: dict[bytes, int], pattern: str, unreachable: frozenset[bytes]) -> Bpe:
    if key not in _LATEST:
        _LATEST.clear()
        _LATEST[key] = Bpe(ranks, pattern, unreachable)
    return _LATEST[key]


def _shared(df: DataFrame, ranks: dict[bytes, int], pattern: str):
    """The coder for tasks; a vocabulary of bounded size is sent to them."""
    unreachable = Bpe(ranks, pattern).unreachable
    sent, key = df.sparkSession.sparkContext.broadcast((ranks, unreachable)), uuid.uuid4().hex

    def coder() -> Bpe:
        from readsieve.llm import bpe  # the module of the worker, where the memory lives

        ranks, unreachable = sent.value
        return bpe._coder(key, ranks, pattern, unreachable)

    return coder


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per row: the number of ids, and digests of the ids and of the bytes decoded from them."""
    coder = _shared(docs, ranks, pattern)

    def make():
        bpe = coder()

        def row(doc_id, text):
            n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for block in bpe.packed(text or ""):
                n += len(block) // 4
                of_ids.update(block)
                of_bytes.update(bpe.decode(np.frombuffer(block, "<u4").tolist()))
            return doc_id, n, of_ids.hexdigest(), of_bytes.hexdigest()

        return row

    return per_row(docs, ["doc_id", "text"], DIGEST_SCHEMA, make)


IDS_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("ids", ArrayType(IntegerType()))])


def encode_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The rows of ``docs`` as (doc_id, ids)."""
    coder = _shared(docs, ranks, pattern)

    def make():
        bpe = coder()
        return lambda doc_id, text: (doc_id, bpe.encode(text or ""))

    return per_row(docs, ["doc_id", "text"], IDS_SCHEMA, make)
