"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from pingtrail.llm.common import map_arrow, map_arrow_parts, stored

# Bytes of the content anchors; windows that are hashed at a time; contexts that are sorted at a time, and most of a bucket.
ANCHOR, CHUNK, CONTEXTS = 32, 1 << 20, 2048
# Bytes of text or of contexts that a task turns into one batch of rows; rows of one anchor that are counted in one task.
SLICE, HOT_ROWS = 4 << 20, 50_000
# A difference cover: every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 24) - 1)


def shift_table() -> np.ndarray:
    """For residues r and q the least d below PERIOD such that r + d and q + d are both in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[next(d for d in range(PERIOD) if inside[r + d] and inside[q + d]) for q in range(PERIOD)] for r in range(PERIOD)])


SHIFT = shift_table()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Cuts the starts of all windows of a text into runs that share an anchor, the least-hashed ANCHOR-gram inside the window.

    The anchor depends on a window's content alone (the leftmost of equals), so equal windows have equal anchors
    at equal places, wherever they lie.
    """

    def __init__(self, window: int) -> None:
        if window < 2 * ANCHOR:
            raise ValueError(f"the window must have {2 * ANCHOR} bytes at least")
        self.window, self.span = window, window - ANCHOR + 1
        size = CHUNK + 2 * window
        one = np.ones(size, dtype=np.uint64)
        one[1:] = np.uint64(BASE)
        self.power = np.multiply.accumulate(one)
        one[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        self.inverse = np.multiply.accumulate(one)

    def runs(self, data: bytes) -> Iterator[Runs]:
        """Runs of windows, a chunk of the text at a time."""
        for at in range(0, len(data) - self.window + 1, CHUNK):
            yield self._chunk(data[at:at + CHUNK + self.window - 1], at)

    def _chunk(self, data: bytes, base: int) -> Runs:
        n, w = len(data), self.span
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        grams = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * self.inverse[:n - ANCHOR + 1])
        m = len(grams)
        # sliding minimum of (hash, place) from minima of the fronts and backs of blocks as long as the window
        value = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        value[:m] = (grams & ~PLACE) | np.arange(m, dtype=np.uint64)
        blocks = value.reshape(-1, w)
        front = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:m - w + 1], front[w - 1:m]) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([first, [len(place)]]))
        at = place[first]
        ends = first + count - 1 + self.window
        names = b"".join([_name(data[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)])
        return Runs(first + base, count, at - first, grams[at].view(np.int64), *np.frombuffer(names, "<i8").reshape(-1, 2).T)


@dataclass(frozen=True)
class Runs:
    """Runs of windows with one anchor: first window, number of windows, place of the anchor in the first window, hash of the
    anchor, and 128 bits that name the run's whole context (all bytes of its windows)."""

    first: np.ndarray
    count: np.ndarray
    left: np.ndarray
    anchor: np.ndarray
    name1: np.ndarray
    name2: np.ndarray


def _name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _joined(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one row that follow each other without a gap as one."""
    order = np.lexsort((first, row))
    row, first, count = row[order], first[order], count[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + count[:-1])]) if len(row) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return row[start], first[start], np.add.reduceat(count, start) if len(start) else count


def repeated_windows(contexts: list[bytes], counts: np.ndarray, bucket: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows among the suffix starts of contexts, bucket by bucket.

    ``counts`` says how many windows start in each context, ``bucket`` in which bucket they lie. Returns the context and the place
    of each window and its class number. Suffixes are sorted by bucket, by their first 16 bytes and by the last bytes of the
    window. Longer ties are resolved by the ranks of a cover sample, computed before for all sample positions of the
    text by doubling: for two tied suffixes there is a shift below PERIOD that takes both to sample positions, and
    equal ranks there mean equal bytes up to the part that the sort has compared.
    """
    lengths = np.array([len(c) for c in contexts], dtype=np.int64)
    text = np.frombuffer(b"".join(contexts) + bytes(window + 16), dtype=np.uint8)
    n = int(lengths.sum())
    word = np.zeros(n + window + 8, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | text[k:k + len(word)]
    owner = np.repeat(np.arange(len(contexts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(lengths) - lengths)[owner] + inside

    covered = (window - PERIOD + 1) // PERIOD * PERIOD  # bytes that a rank stands for
    sample, rank = _cover_ranks(word, n, covered)
    rank_at = np.zeros(n + PERIOD, dtype=np.int64)
    rank_at[sample] = rank

    tail = [word[start + at] for at in range(window - 8, covered - 8, -8)]
    keys = [*tail, word[start + 8], word[start], bucket[owner]]
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    tie = np.empty(len(order), dtype=np.int64)
    tie[order] = np.cumsum(new)
    # each round the first open suffix of every tie stands for a class, and all that equal it join
    classes = np.empty(len(order), dtype=np.int64)
    todo, next_class = order, 0
    while len(todo):
        groups, first, which = np.unique(tie[todo], return_index=True, return_inverse=True)
        pivot = todo[first][which]
        shift = SHIFT[start[pivot] % PERIOD, start[todo] % PERIOD]
        same = rank_at[start[pivot] + shift] == rank_at[start[todo] + shift]
        classes[todo[same]] = next_class + which[same]
        next_class += len(groups)
        todo = todo[~same]
    return owner, inside, classes


def _cover_ranks(word: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample positions and the ranks of the ``length`` bytes from each (a multiple of PERIOD), by doubling."""
    sample = np.arange(n)[np.isin(np.arange(n) % PERIOD, COVER)]
    slot = np.full(n + length + PERIOD, -1, dtype=np.int64)
    slot[sample] = np.arange(len(sample))
    # PERIOD bytes as two overlapping words
    first = np.unique(word[sample], return_inverse=True)[1].astype(np.uint64)
    last = np.unique(word[sample + PERIOD - 8], return_inverse=True)[1].astype(np.uint64)
    rank = np.unique(first << np.uint64(32) | last, return_inverse=True)[1]
    done = PERIOD
    while done < length:
        step = min(done, length - done)
        later = slot[sample + step]
        second = np.where(later >= 0, rank[later] + 1, 0)
        rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), return_inverse=True)[1]
        done += step
    return sample, rank


def _spans(first: np.ndarray, count: np.ndarray, window: int, size: int) -> np.ndarray:
    """Maximal covered byte runs (start, end) of runs of window starts."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + count - 1 + window, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(change)[:size] > 0, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the text compressed, which is what moves in shuffles."""
    def make():
        coder = zstandard.ZstdCompressor(level=3)

        def work(batch: pa.RecordBatch) -> dict:
            out = {c: batch.column(i) for i, c in enumerate(columns)}
            return out | {"packed": [coder.compress(t.encode()) for t in batch.column(len(columns)).to_pylist()]}

        return work

    return map_arrow(docs.select(*columns, "text"), make, StructType([*(docs.schema[c] for c in columns), StructField("packed", BinaryType())]))


def _find_runs(long_enough: DataFrame, window: int) -> DataFrame:
    """Runs of all texts. Within a slice one row stands for all runs of the same context (copies); all of those are repeats,
    which come as rows of their own, neighbours joined."""
    def make():
        anchors = Anchors(window)

        def rows(classes: pa.Array, held: list[tuple[int, Runs]]) -> dict:
            row = np.repeat([i for i, _ in held], [len(r.first) for _, r in held])
            first, count, left, anchor, name1, name2 = (np.concatenate([getattr(r, f) for _, r in held]) for f in Runs.__dataclass_fields__)
            order = np.lexsort((name2, name1))
            new = np.concatenate([[True], (name1[order][1:] != name1[order][:-1]) | (name2[order][1:] != name2[order][:-1])])
            copies = np.bincount(np.cumsum(new) - 1)
            lead, again = order[new], order[np.repeat(copies > 1, copies)]
            again_row, again_first, again_count = _joined(row[again], first[again], count[again])
            n, none = len(again_row), np.zeros(len(again_row), dtype=np.int64)
            return {"class": classes.take(pa.array(np.concatenate([row[lead], again_row]))), "repeat": np.arange(len(lead) + n) >= len(lead),
                    "first": np.concatenate([first[lead], again_first]), "count": np.concatenate([count[lead], again_count]),
                    "left": np.concatenate([left[lead], none]).astype(np.int32), "anchor": np.concatenate([anchor[lead], none]),
                    "name1": np.concatenate([name1[lead], none]), "name2": np.concatenate([name2[lead], none]), "copies": np.concatenate([copies, none + 1])}

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            held, size = [], 0
            for i, text in enumerate(batch.column(1)):
                for runs in anchors.runs(text.as_py().encode()):
                    held.append((i, runs))
                    size += int(runs.count.sum())
                    if size >= SLICE:
                        yield rows(batch.column(0), held)
                        held, size = [], 0
            if held:
                yield rows(batch.column(0), held)

        return work

    return stored(map_arrow_parts(long_enough, make, "class binary, repeat boolean, first long, count long, left int, anchor long, "
                                  "name1 long, name2 long, copies long"), "suffix-runs")


def _hot_anchors(runs: DataFrame) -> DataFrame:
    """Anchors with so many rows that several tasks count them, 1000 at most, from a sketch of bounded size."""
    found = runs.agg(F.expr("approx_top_k(anchor, 1000, 20000)").alias("top")).first().top or []
    return runs.sparkSession.createDataFrame([(r["item"], -(-r["count"] // HOT_ROWS)) for r in found if r["item"] is not None and r["count"] > HOT_ROWS],
                                             "anchor long, salts long")


def _cut_contexts(window: int):
    """Cuts contexts by the place of the anchor in their windows: the lower and the upper half of the range of places.

    Equal windows hold the anchor at the same place, and all windows of a half share some bytes on either side of it, the
    more the narrower the range. These bytes are the half's new key, so equal windows meet again.
    """
    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {f: [] for f in PARTS.split()}
            size = 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cls, first, count, left, copies, low, high, data = row
                middle = (low + high) // 2
                for x, y in ((low, middle), (middle + 1, high)):
                    most, least = min(left, y), max(left - count + 1, x)
                    if least > most or x > y:
                        continue
                    skip, n = left - most, most - least + 1
                    part = data[skip:skip + n - 1 + window]
                    key = hashlib.blake2b(part[most - x:most + window - y], digest_size=8, salt=x.to_bytes(2, "little")).digest()
                    name1, name2 = np.frombuffer(hashlib.blake2b(part, digest_size=16, salt=x.to_bytes(2, "little")).digest(), "<i8").tolist()
                    for f, value in zip(out, (int.from_bytes(key, "little", signed=True), name1, name2, cls, first + skip, n, most, copies, x, y, part), strict=True):
                        out[f].append(value)
                    size += len(part)
                if size >= SLICE:
                    yield out
                    out, size = {f: [] for f in out}, 0
            if size:
                yield out

        return work

    return make


PARTS = "key name1 name2 class first count left copies low high bytes"


def _split_large(large: DataFrame, window: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Buckets of more than CONTEXTS contexts as smaller ones (key, class, first, count, copies, bytes), and repeats found on the way.

    Each round halves the range of anchor places. A context gives two rows at most; what is now equal becomes one with its
    copies; buckets that are small enough leave. Where the range is one place, equal keys are equal windows, so it ends.
    """
    small, repeats, round_no = [], [], 0
    large = stored(large, "suffix-large")
    while not large.isEmpty():
        parts = map_arrow_parts(large.select("class", "first", "count", "left", "copies", "low", "high", "bytes"), _cut_contexts(window),
                                "key long, name1 long, name2 long, class binary, first long, count long, left int, copies long, low int, high int, bytes binary")
        parts = stored(parts, f"suffix-parts{round_no}")
        named = (parts.groupBy("key", "name1", "name2").agg(F.sum("copies").alias("all"), F.min(F.struct("class", "first")).alias("lead")))
        named = stored(named, f"suffix-names{round_no}")
        sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
        met = parts.drop("copies").join(named, ["key", "name1", "name2"]).join(sizes, "key", "left")
        leads = (F.struct("class", "first") == F.col("lead")) & F.col("contexts").isNotNull()
        met = (met.withColumn("leads", leads).where("all > 1 OR leads")
               .select("key", "class", "first", "count", "left", F.col("all").alias("copies"), "contexts", "leads", "low", "high", F.when(F.col("leads"), F.col("bytes")).alias("bytes")))
        met = stored(met, f"suffix-split{round_no}")
        repeats.append(met.where("copies > 1").select("class", "first", "count"))
        small.append(met.where(F.col("leads") & (F.col("contexts") <= CONTEXTS)).select("key", "class", "first", "count", "copies", "bytes"))
        large = met.where(F.col("leads") & (F.col("contexts") > CONTEXTS))
        round_no += 1
    return small, repeats


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, window: int = 200, as_text: bool = False) -> DataFrame:
    """One row a document: its id, n_bytes, spans (removed runs as start and end) and kept (the remaining bytes).

    With ``as_text`` kept is a string, without the characters of which a cut took some bytes only. The id may be of any
    type, so a struct of all other columns carries a whole document along.

    A byte goes when it lies in a string of ``window`` bytes that starts anywhere else too, in this or another document; all
    copies go, and strings are judged on the input. Matches do not cross documents.

    1. Windows are cut into runs that share a content anchor, so equal windows fall into one bucket. A run's context is named
       by a BLAKE2 digest of its bytes; runs whose whole context occurs again are repeats as they are. Buckets with one
       context and one occurrence hold none.
    2. One context of each kind in the remaining buckets is sorted, a limited number of contexts at a time, by
       ``repeated_windows``. A bucket with very many contexts is first split by the bytes around its anchor that its windows
       share, again and again, until its parts are small.
    3. Runs of repeated windows meet their text again and become byte spans.

    A null or empty text has no bytes; one shorter than the window keeps all. Equal texts are looked at as one where
    only the content matters. Repeated rows are repeats of each other. Null ids are carried along. An empty table gives an
    empty result. Other columns are not read. Long texts are read a chunk at a time and rows leave a task in slices.
    """
    id_field = docs.schema[doc_id]
    plain = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = plain.withColumn("class", F.unhex(F.md5("text")))
    long_enough = plain.where(F.octet_length("text") >= window)

    runs = _find_runs(long_enough.select("class", "text"), window)
    same, bucket = Window.partitionBy("anchor", "salt", "name1", "name2"), Window.partitionBy("anchor", "salt")
    flagged = (runs.where("NOT repeat").drop("repeat").join(F.broadcast(_hot_anchors(runs.where("NOT repeat"))), "anchor", "left")
               .withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod("name1", F.col("salts")))
               .repartition("anchor", "salt")
               .withColumn("place", F.row_number().over(same.orderBy("class", "first")))
               .withColumn("copies", F.sum("copies").over(same))
               .withColumn("contexts", F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).over(bucket))
               .withColumn("large", (F.col("salts") > 1) | (F.col("contexts") > CONTEXTS))
               .where("copies > 1 OR contexts > 1 OR large"))
    flagged = stored(flagged.select("class", "first", "count", "left", "anchor", "copies", "large", (F.col("place") == 1).alias("leads"),
                                    (F.col("large") | (F.col("contexts") > 1)).alias("shared")), "suffix-flagged")
    marks = runs.where("repeat").select("class", "first", "count").unionByName(flagged.where("copies > 1").select("class", "first", "count"))

    wanted = (flagged.where("leads AND shared").select("class", F.struct("first", "count", "left", "anchor", "copies", "large").alias("run"))
              .groupBy("class").agg(F.collect_list("run").alias("runs")))
    with_text = _packed(long_enough, ["class"]).dropDuplicates(["class"]).join(wanted, "class")

    def make_contexts():
        unpack = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            names = ("class", "first", "count", "left", "anchor", "copies", "large", "bytes")
            out: dict[str, list] = {k: [] for k in names}
            size = 0
            for cls, packed, items in zip(*batch.columns, strict=True):
                data = unpack.decompress(packed.as_py())
                for run in items.as_py():
                    out["class"].append(cls.as_py())
                    for name, value in run.items():
                        out[name].append(value)
                    out["bytes"].append(data[run["first"]:run["first"] + run["count"] - 1 + window])
                    size += run["count"] + window
                    if size >= SLICE:
                        yield out
                        out, size = {k: [] for k in names}, 0
            if size:
                yield out

        return work

    contexts = map_arrow_parts(with_text.select("class", "packed", "runs"), make_contexts,
                               "class binary, first long, count long, left int, anchor long, copies long, large boolean, bytes binary")
    few = [contexts.where("NOT large").select(F.col("anchor").alias("key"), "class", "first", "count", "copies", "bytes")]
    if not flagged.where("large").isEmpty():
        contexts = stored(contexts, "suffix-contexts")
        few = [contexts.where("NOT large").select(F.col("anchor").alias("key"), "class", "first", "count", "copies", "bytes")]
        places = contexts.where("large").withColumns({"low": F.lit(0), "high": F.lit(window - ANCHOR)})
        more, repeats = _split_large(places, window)
        few += more
        for found in repeats:
            marks = marks.unionByName(found)
    dealt = few[0]
    for part in few[1:]:
        dealt = dealt.unionByName(part)
    sorted_ = (dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_buckets(window), "class binary, first long, count long"))
    marks = marks.unionByName(stored(sorted_, "suffix-windows"))

    spans = marks.distinct().groupBy("class").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    schema = StructType([StructField(doc_id, id_field.dataType), StructField("n_bytes", LongType()),
                         StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
                         StructField("kept", StringType() if as_text else BinaryType())])

    def make_kept():
        unpack = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            begin, size, sizes, all_spans, kept = 0, 0, [], [], []

            def done(end: int) -> dict:
                texts = [k.decode(errors="ignore") for k in kept] if as_text else kept
                return {doc_id: batch.column(0).slice(begin, end - begin), "n_bytes": sizes, "spans": all_spans, "kept": texts}

            for i, (packed, items) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                data = unpack.decompress(packed.as_py())
                cut = np.empty((0, 2), dtype=np.int64)
                if items.is_valid:
                    first, count = (items.values.field(k).to_numpy() for k in ("first", "count"))
                    cut = _spans(first, count, window, len(data))
                edges = [0, *cut.ravel().tolist(), len(data)]
                sizes.append(len(data))
                all_spans.append([{"start": a, "end": b} for a, b in cut.tolist()])
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                size += len(data)
                if size >= SLICE:
                    yield done(i + 1)
                    begin, size, sizes, all_spans, kept = i + 1, 0, [], [], []
            if sizes:
                yield done(batch.num_rows)

        return work

    joined = _packed(plain, ["id", "class"]).join(spans, "class", "left")
    return map_arrow_parts(joined.select("id", "packed", "runs"), make_kept, schema)


def _sort_buckets(window: int):
    """Reads contexts in order of bucket, sorts a limited number at a time (whole buckets) and gives runs of repeated windows."""

    def run(batches):
        schema = pa.schema([("class", pa.binary()), ("first", pa.int64()), ("count", pa.int64())])
        held: list[tuple] = []

        def solve() -> list[tuple]:
            key, cls, first, counts, copies, data = zip(*held, strict=True)
            bucket = np.cumsum([0] + [a != b for a, b in zip(key[1:], key[:-1], strict=True)])
            owner, inside, classes = repeated_windows(list(data), np.array(counts, dtype=np.int64), bucket, window)
            # a context that occurs several times is a repeat already
            mine = np.flatnonzero((np.bincount(classes)[classes] > 1) & (np.array(copies) == 1)[owner])
            cut = np.flatnonzero((np.diff(inside[mine]) != 1) | (np.diff(owner[mine]) != 0)) + 1
            rows = [(cls[owner[part[0]]], first[owner[part[0]]] + int(inside[part[0]]), len(part)) for part in np.split(mine, cut) if len(part)]
            held.clear()
            return rows

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and len(held) >= CONTEXTS:
                    rows = solve()
                    if rows:
                        yield table(rows)
                held.append(row)
        if held:
            rows = solve()
            if rows:
                yield table(rows)

    return run
