"""Near-duplicates by circulant MinHash with exact verification (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pingtrail.llm.common import component_of_class, components, map_arrow, stored

# 32 bands of 5 coordinates miss a pair of similarity 0.80 with a chance of 3e-6, one of 0.85 with 7e-9.
BANDS, ROWS = 32, 5
# Words of 64 bits in the parity map of a set.
WORDS = 16
PARITY = [f"parity{k}" for k in range(WORDS)]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z lower-cased, words apart by ASCII white space.

    With fewer words the whole sequence is one shingle; without a word the set is empty.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(words_per_shingle, len(words))
    joined = _mixed(hashes[:len(words) - width + 1])
    for k in range(1, width):
        joined = _mixed(joined + hashes[k:len(words) - width + 1 + k])
    return np.unique(joined)


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash of a set that is not empty: ``length`` coordinates from two permutations of a ring of 2**32 places.

    The first permutation gives each element its place. Coordinate k is the smallest value of the second one after all
    places are shifted circularly by k.
    """
    place = (_mixed(shingles + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(length, 0xFFFFFFFF, dtype=np.uint32)
    shifts = np.arange(length, dtype=np.uint32)[:, None]
    for at in range(0, len(place), 1024):
        value = place[None, at:at + 1024] + shifts
        value *= np.uint32(0xCC9E2D51)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x1B873593)
        value ^= value >> np.uint32(13)
        value *= np.uint32(0x85EBCA6B)
        np.minimum(least, value.min(axis=1), out=least)
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different for equal values in different bands."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = _mixed(key + rows[:, k])
    return key.view(np.int64)


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * WORDS cells: whether an odd number of the set's shingles falls there.

    Two maps differ in at most as many bits as there are shingles that only one of the sets has.
    """
    cells = _mixed(shingles ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(64 * WORDS - 1)
    odd = (np.bincount(cells.astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    common = int(np.isin(a, b, assume_unique=True).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    both = (pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a"))

    def make():
        recent: dict[bytes, np.ndarray] = {}

        def set_of(key: bytes, text: str) -> np.ndarray:
            if key not in recent:
                if len(recent) >= 256:
                    recent.clear()
                recent[key] = shingle_set(text, words)
            return recent[key]

        def work(batch: pa.RecordBatch) -> dict:
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            good = [_linked(set_of(a[i], text_a[i]), shingle_set(text_b[i], words), percent) for i in range(len(a))]
            found = batch.filter(pa.array(good, pa.bool_()))
            return {"a": found.column(0), "b": found.column(1)}

        return work

    return map_arrow(both.select("a", "b", "text_a", "text_b"), make, "a binary, b binary")


def _fits(left: str, right: str, percent: int) -> Column:
    """Sets of these sizes and parity maps can be similar enough; false only for pairs that cannot."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{left}.{p}").bitwiseXOR(F.col(f"{right}.{p}"))) for p in PARITY), F.lit(0))
    return (F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)) & (
        F.lit(100 + percent) * apart <= F.lit(100 - percent) * (a + b))


def _candidates(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The different pairs (x, y) of classes that may be linked, the smaller class as a."""
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return (pairs.join(sets.alias("x"), F.col("a") == F.col("x.class")).join(sets.alias("y"), F.col("b") == F.col("y.class"))
            .where(_fits("x", "y", percent)).select("a", "b"))


def _open_bands(shared: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """band, class and root of the members of buckets that still hold several components of these links."""
    roots = components(links, name).withColumnRenamed("node", "class")
    rooted = stored(shared.join(roots, "class", "left").select("band", "class", F.coalesce("root", "class").alias("root")), f"{name}-rooted")
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    return stored(rooted.join(several, "band", "left_semi"), name)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: its id, n_shingles, component_id and kept.

    Documents are linked when ``100 * common >= percent * union`` holds for their sets of word shingles. Equal texts form
    a class; classes that share a band are compared. First all members of a band's bucket are compared with its smallest one,
    then, in buckets that still hold several components, with the one that has most links; this ties groups of copies
    together in as many comparisons as members. In buckets that hold several components even then, members
    of different components are compared with each other, so no candidate is given up.
    Before sets are fetched, pairs are ruled out by sizes and parity maps, which only rules out what cannot be
    linked; so a crowd of loosely similar texts gives few pairs. Every link is confirmed on full shingle sets.

    Null and empty texts, and texts without a word, have no shingles and link with nothing, not even
    with equal ones. Null ids can be members but name no component unless nothing else is there. Repeated rows
    belong together and are all kept if their id is the component's. Ties do not arise. An empty table
    gives an empty result. Columns other than the id and the text are not read.
    """
    spare = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    classed = spare.withColumn("class", F.unhex(F.md5(F.col("text"))))
    schema = StructType([classed.schema["id"], classed.schema["class"], StructField("n_shingles", LongType()),
                         StructField("bands", ArrayType(LongType())), *(StructField(p, LongType()) for p in PARITY)])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
            maps = np.array([parity_map(s) for s in sets]).reshape(len(sets), WORDS)
            return {"id": batch.column(0), "class": batch.column(1), "n_shingles": [len(s) for s in sets],
                    "bands": [band_keys(signature(s, BANDS * ROWS)) if len(s) else None for s in sets],
                    **{p: maps[:, k] for k, p in enumerate(PARITY)}}

        return work

    rows = stored(map_arrow(classed.select("id", "class", "text"), make, schema), "minhash-rows")
    distinct = stored(rows.where("n_shingles > 0").drop("id").dropDuplicates(["class"]), "minhash-distinct")
    spread = distinct.select("class", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("leader")).where("n > 1")
    shared = stored(spread.join(buckets.select("band", "leader"), "band"), "minhash-shared")
    sets = distinct.drop("bands")

    needed = shared.select("class").distinct()
    texts = stored(classed.select("class", "text").join(needed, "class", "left_semi").dropDuplicates(["class"]), "minhash-texts")
    star = _candidates(shared.where("`class` <> leader").select(F.col("leader").alias("x"), F.col("class").alias("y")), sets, percent)
    tested = stored(star, "minhash-star1")
    links = stored(_verified(tested, texts, words, percent), "minhash-links1")
    still = _open_bands(shared, links, "minhash-open1")

    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").count()
    ranked = still.join(ends, "class", "left").withColumn("place", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "class"))
    central = ranked.groupBy("band").agg(F.max("place").alias("most")).select("band", F.col("most.class").alias("x"))
    central = central.join(still.select("band", F.col("class").alias("x"), F.col("root").alias("x_root")), ["band", "x"])
    star = _candidates(still.join(central, "band").where("root <> x_root").select("x", F.col("class").alias("y")), sets, percent)
    star = stored(star.join(tested, ["a", "b"], "left_anti"), "minhash-star2")
    tested = tested.unionByName(star)
    links = stored(links.unionByName(_verified(star, texts, words, percent)), "minhash-links2")
    still = _open_bands(shared, links, "minhash-open2").join(distinct, "class")

    cross = (still.alias("x").join(still.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.class") < F.col("y.class"))
                                   & (F.col("x.root") != F.col("y.root")) & _fits("x", "y", percent)
                                   # a pair may share many bands and is taken in the first of them
                                   & (F.col("x.band") == F.array_min(F.array_intersect("x.bands", "y.bands"))))
             .select(F.col("x.class").alias("a"), F.col("y.class").alias("b")))
    cross = stored(cross.join(tested, ["a", "b"], "left_anti"), "minhash-cross")
    links = links.unionByName(_verified(cross, texts, words, percent))

    members = component_of_class(rows.where("n_shingles > 0"), links, "minhash", id_column="id", class_column="class")
    found = rows.where("n_shingles > 0").join(members.select("class", F.col("component_id").alias("least")), "class", "left")
    found = found.select("id", "n_shingles", F.coalesce("least", "id").alias("component_id"))
    bare = rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.unionByName(bare).select(F.col("id").alias(doc_id), "n_shingles", "component_id",
                                          F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
