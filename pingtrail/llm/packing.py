"""Best-fit packing of token pieces by exact complements (operator 7)."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pingtrail.llm.common import map_arrow, stored
from pingtrail.llm.tokens import WordTokenizerWithSpecials, shared

# Rows of one length are numbered in cells of about this many rows each.
ROWS_PER_CELL = 50_000
ROW = "_packing_row"
Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...) and the number of sequences filled so


def token_pieces(docs: DataFrame, path: str, capacity: int, text: str = "text", *, end_id: int = 1,
                 keep: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of the token ids of each whole text followed by ``end_id``: keep, piece, start, length, ids_crc32 (and ids).

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, which finds special tokens written in the text.
    Only texts of more than ``capacity`` ids are cut, every ``capacity`` ids. A null or empty text is the piece of its end id
    alone. Repeated rows and null ids give pieces like any other; columns other than ``keep`` and the text are not read.
    """
    fields = [docs.schema[keep], StructField("piece", IntegerType()), StructField("start", LongType()),
              StructField("length", LongType()), StructField("ids_crc32", LongType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(LongType())))
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        tokenizer = shared(WordTokenizerWithSpecials, path)

        def work(batch: pa.RecordBatch) -> dict:
            row, piece, crc, length, ids = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                data = tokenizer.encode(value or "") + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            out = {keep: batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "length": length,
                   "start": [k * capacity for k in piece], "ids_crc32": crc}
            return out | ({"ids": ids} if with_ids else {})

        return work

    return map_arrow(docs.select(keep, text), make, StructType(fields))


class Lengths:
    """How often each length is free, and an index of the sums of two of them.

    ``pairs[s]`` is the number of pairs of free lengths that add up to s; a length pairs with itself if two are free.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.free = np.zeros(capacity + 1, dtype=np.int64)
        self.pairs = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self._others(length, 1)
            self.free[length] = n
            if n > 1 and 2 * length <= capacity:
                self.pairs[2 * length] += 1

    def _others(self, length: int, change: int) -> None:
        sums = np.flatnonzero(self.free[:self.capacity - length + 1]) + length
        self.pairs[sums] += change

    def use(self, length: int, n: int) -> None:
        before = self.free[length]
        self.free[length] = left = before - n
        if left < 2 <= before and 2 * length <= self.capacity:
            self.pairs[2 * length] -= 1
        if not left:
            self._others(length, -1)

    def complement(self, gap: int, taken: Counter) -> tuple[int, ...] | None:
        """One, two or three free lengths that add up to ``gap`` exactly, given what the sequence has taken already.

        Singles come before pairs before triples; among pairs the most even, among triples the largest smallest part, which
        leaves the short lengths for later gaps.
        """
        left = self.free[:gap + 1].copy()
        for length, copies in taken.items():
            if length <= gap:
                left[length] -= copies
        if left[gap] > 0:
            return (gap,)
        lengths = np.flatnonzero(left[:gap] > 0)
        if self.pairs[gap]:
            low = lengths[lengths <= gap // 2]
            good = low[(left[gap - low] > 0) & ((gap - low != low) | (left[low] > 1))]
            if len(good):
                return int(good[-1]), int(gap - good[-1])
        thirds = lengths[lengths <= gap // 3]
        for third in thirds[self.pairs[gap - thirds] > 0][::-1]:
            rest = gap - third
            low = lengths[(lengths >= third) & (lengths <= rest // 2)]
            high = rest - low
            need_low, need_high = 1 + (low == third) + (low == high), 1 + (high == third) + (low == high)
            good = low[(left[low] >= need_low) & (left[high] >= need_high)]
            if len(good):
                return int(third), int(good[-1]), int(rest - good[-1])
        return None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every length as often as it occurs, few of them with room left.

    Works on the counts of the lengths (``capacity`` numbers at most), never on pieces: the longest free length opens a
    sequence; a single, pair or triple that fills the gap exactly closes it; else the longest length that fits
    goes in and the search is repeated for the smaller gap. A pattern is used at once as often as its lengths are free.
    """
    lengths = Lengths(counts, capacity)
    free = lengths.free
    patterns: list[Pattern] = []
    longest = capacity
    while longest > 0:
        if not free[longest]:
            longest -= 1
            continue
        taken = Counter([longest])
        gap = capacity - longest
        while gap > 0:
            exact = lengths.complement(gap, taken)
            if exact:
                taken.update(exact)
                break
            fitting = np.flatnonzero(free[:gap + 1] > 0)
            fitting = [x for x in fitting[::-1][:len(taken) + 1] if free[x] > taken[int(x)]]
            if not fitting:
                break
            taken[int(fitting[0])] += 1
            gap -= int(fitting[0])
        n = int(min(free[length] // copies for length, copies in taken.items()))
        for length, copies in taken.items():
            lengths.use(length, n * copies)
        patterns.append((tuple(sorted(taken.items(), reverse=True)), n))
    return patterns


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless from 0 in each sequence, in as few sequences as the plan finds.

    Only the counts of the lengths reach the driver. Pieces of one length are interchangeable: each gets its number among
    them (from counts of cells, so a length that holds a third of all rows is numbered by many tasks) and the
    pattern that covers that number gives its place. Lengths outside 1..capacity raise an error. Repeated pieces are
    placed separately. An empty input gives an empty result. Columns named sequence_id, offset or ``_packing_row`` are replaced.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", ROW)]
    # a number for each row, fixed in the stored table: equal rows are told apart and dealt over all cells
    pieces = stored(pieces.select(*kept, F.monotonically_increasing_id().alias(ROW)), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if wrong := [n for n in counts if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {wrong[:5]}")
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequences = 0
    for members, n in plan_sequences(counts, capacity):
        place = 0
        for size, copies in members:
            slots.setdefault(size, []).append((used[size], sequences, copies, place))
            used[size] += n * copies
            place += size * copies
        sequences += n
    places = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in slots.items()})

    cells = max(1, sum(counts.values()) // ROWS_PER_CELL)
    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64(ROW), F.lit(cells)))
    before = Window.partitionBy(length).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(length, "_cell").count().select(
        length, "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(length, "_cell").orderBy(ROW)) - 1
    numbered = (dealt.withColumn("_within", within).join(first, [length, "_cell"])
                .select(*kept, (F.col("_first") + F.col("_within")).alias("_rank")))
    schema = StructType([*(pieces.schema[c] for c in kept), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
            size = columns[length].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            by_size = np.argsort(size, kind="stable")
            for rows in np.split(by_size, np.flatnonzero(np.diff(size[by_size])) + 1):
                if len(rows):
                    table = places.value[int(size[rows[0]])]
                    at = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                    since = rank[rows] - at[:, 0]
                    sequence[rows] = at[:, 1] + since // at[:, 2]
                    offset[rows] = at[:, 3] + since % at[:, 2] * size[rows]
            return columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}

        return work

    return map_arrow(numbered, make, schema)
