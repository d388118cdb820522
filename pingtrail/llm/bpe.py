"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap (operator 4)."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from pingtrail.llm.common import map_arrow
from pingtrail.llm.tokens import Remembered

WORD = 64
# Bytes of pre-tokens that are merged together.
MERGED_BYTES = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class RankQueue:
    """Positions waiting to be merged, in buckets by rank.

    A bit in ``low`` marks each rank whose bucket is not empty, a bit in ``high`` each word of ``low`` that is not zero; the
    smallest rank is found by two find-first-set steps, whatever the number of ranks.
    """

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.high = 0

    def add(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, bit = divmod(rank, WORD)
        self.low[word] = self.low.get(word, 0) | 1 << bit
        self.high |= 1 << word

    def take(self) -> tuple[int, list[int]] | None:
        """The smallest rank and all its positions, removed."""
        if not self.high:
            return None
        word = (self.high & -self.high).bit_length() - 1
        bits = self.low[word]
        bit = (bits & -bits).bit_length() - 1
        bits &= bits - 1
        if bits:
            self.low[word] = bits
        else:
            del self.low[word]
            self.high &= self.high - 1
        rank = word * WORD + bit
        return rank, self.buckets.pop(rank)


def two_byte_ranks(ranks: dict[bytes, int]) -> np.ndarray:
    """Rank of each pair of bytes, -1 for none."""
    table = np.full(1 << 16, -1, dtype=np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            table[token[0] << 8 | token[1]] = rank
    return table


def merge_all(pretokens: list[bytes], ranks: dict[bytes, int], two_bytes: np.ndarray) -> list[list[int]]:
    """Token ids of each pre-token: the pair of smallest rank merges first, the leftmost of equals, until none is left.

    All pre-tokens lie in one buffer and share one queue, as pairs of different ranks or pre-tokens do not disturb each
    other. Parts are a doubly linked list over byte positions; ``pair`` holds the rank of each part with the
    next one. An entry of the queue whose rank is not the pair's any more is stale and skipped.
    """
    data = b"".join(pretokens)
    n = len(data)
    edge = bytearray(n + 1)  # 1 where a pre-token starts, and at the end
    at = 0
    for pretoken in pretokens:
        edge[at] = 1
        at += len(pretoken)
    edge[n] = 1
    get = ranks.get
    make = list if n <= MERGED_BYTES else partial(array, "i")  # very long pre-tokens: four bytes a number
    after = make(range(1, n + 1))   # end of the part that starts here
    before = make(range(-1, n))     # start of the part before
    queue = RankQueue()
    add, waiting = queue.add, queue.buckets
    bytes_ = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    pairs = two_bytes[bytes_[:-1] * 256 + bytes_[1:]] if n > 1 else np.empty(0, np.int64)
    pairs[np.frombuffer(edge, dtype=np.uint8)[1:n] == 1] = -1
    pair = make(np.append(pairs, -1).astype("i4").tolist() if make is list else np.append(pairs, -1).astype("i4").tobytes())
    order = np.argsort(pairs, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(pairs[order])) + 1):
        if len(group) and pairs[group[0]] >= 0:
            add(int(pairs[group[0]]), int(group[0]))
            waiting[int(pairs[group[0]])] = group.tolist() if make is list else make(group.astype("i4").tobytes())
    while (item := queue.take()) is not None:
        rank, positions = item
        positions = sorted(positions)
        for index, at in enumerate(positions):
            if pair[at] != rank:
                continue
            middle = after[at]
            end = after[middle]
            pair[middle] = -1
            after[at] = end
            smallest = rank
            if edge[end]:
                pair[at] = -1
            else:
                before[end] = at
                new = get(data[at:after[end]])
                if new is None:
                    pair[at] = -1
                else:
                    pair[at] = new
                    bucket = waiting.get(new)
                    if bucket is None:
                        add(new, at)
                        if new < smallest:
                            smallest = new
                    else:
                        bucket.append(at)
            if not edge[at]:
                previous = before[at]
                new = get(data[previous:end])
                if new is None:
                    pair[previous] = -1
                else:
                    pair[previous] = new
                    bucket = waiting.get(new)
                    if bucket is None:
                        add(new, previous)
                        if new < smallest:
                            smallest = new
                    else:
                        bucket.append(previous)
            if smallest < rank:  # a smaller rank came up: the rest of this bucket waits
                for later in positions[index + 1:]:
                    add(rank, later)
                break
    out: list[list[int]] = []
    at = 0
    while at < n:
        ids = [ranks[data[at:after[at]]]]
        at = after[at]
        while not edge[at]:
            ids.append(ranks[data[at:after[at]]])
            at = after[at]
        out.append(ids)
    return out


def slices(pretokens: list[tuple[str, bytes]], most_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The list in parts of ``most_bytes`` at most; a longer pre-token is a part of its own."""
    part, size = [], 0
    for pretoken in pretokens:
        if part and size + len(pretoken[1]) > most_bytes:
            yield part
            part, size = [], 0
        part.append(pretoken)
        size += len(pretoken[1])
    if part:
        yield part


class Encoder:
    """Encodes texts by ranks and a pre-token pattern, and decodes ids.

    What follows a blank up to the next one is looked up as a whole in a bounded memory of recent results; the
    pattern and the merges run only for what is not there. Every byte needs a rank, else a KeyError is raised.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_bytes: int = 320 << 20) -> None:
        import regex

        self.ranks, self.two_bytes = ranks, two_byte_ranks(ranks)
        self.split = regex.compile(pattern).findall
        self.white = regex.compile(r"\s ").search
        self.runs = regex.compile(r"\s*\S+|\s+").findall
        self.pieces, self.pretokens = Remembered(most_bytes * 2 // 3), Remembered(most_bytes // 3)
        size = max(ranks.values(), default=0) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.content = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _cut(self, text: str) -> list[str]:
        """Pieces whose pre-tokens are those of the text: cut before white space that follows something else."""
        if self.white(text):
            return self.runs(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + p for p in rest]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        split = {piece: self.split(piece) for piece in pieces}
        known, new = {}, []
        for matches in split.values():
            for match in matches:
                if match not in known:
                    ids = self.pretokens.get(match)
                    if ids is None:
                        data = match.encode()
                        whole = self.ranks.get(data)
                        if whole is None:
                            new.append((match, data))
                        else:
                            ids = np.array([whole], dtype=np.int32).tobytes()
                    known[match] = ids
        for some in slices(new, MERGED_BYTES):
            for (match, _), ids in zip(some, merge_all([data for _, data in some], self.ranks, self.two_bytes), strict=True):
                known[match] = np.array(ids, dtype=np.int32).tobytes()
        for match, ids in known.items():
            self.pretokens.put(match, ids)
        found = {piece: b"".join([known[m] for m in matches]) for piece, matches in split.items()}
        for piece, ids in found.items():
            self.pieces.put(piece, ids)
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._cut(text) if text else [] for text in texts]
        local: dict[str, bytes | None] = {}
        young, old = self.pieces.young, self.pieces.old
        missing = []
        for pieces in cut:
            for piece in pieces:
                if piece not in local:
                    ids = young.get(piece)
                    if ids is None:
                        ids = old.get(piece)
                        if ids is None:
                            missing.append(piece)
                    local[piece] = ids
        if missing:
            local.update(self._learn(missing))
        return [np.frombuffer(b"".join([local[p] for p in pieces]), dtype=np.int32) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.content[shift + np.arange(total)].tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process and vocabulary, kept over tasks for what it remembers."""
    key = path, pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[key]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", *, keep: tuple[str, ...] = ("doc_id",),
                      ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The columns ``keep`` with the token ids of the whole text and the bytes that those ids decode to.

    Null and empty texts have no ids. Repeated rows are encoded alike, ids may be null, and columns other than
    ``keep`` and the text are not read. ``path`` must be readable on every executor.
    """
    schema = StructType([*(docs.schema[c] for c in keep), StructField(ids, ArrayType(IntegerType(), False)), StructField(decoded, BinaryType())])

    def make():
        coder = encoder(path, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            rows = coder.encode([t or "" for t in batch.column(len(keep)).to_pylist()])
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
            return dict(zip(keep, batch.columns, strict=False)) | {ids: lists, decoded: [coder.decode(r) for r in rows]}

        return work

    return map_arrow(docs.select(*keep, text), make, schema)
