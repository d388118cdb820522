"""Fill-in-the-middle transformation with a sparse index of multibyte characters (operator 12)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pingtrail.llm.common import map_arrow

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


class ExceptionIndex:
    """Where a UTF-8 text departs from one byte a character: code-point positions of its multibyte characters and the bytes that
    each has beyond its first. Everything else is arithmetic; an ASCII text has an empty index.
    """

    def __init__(self, data: np.ndarray) -> None:
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead]
        excess = 1 + (first >= 0xE0) + (first >= 0xF0)
        self.bytes = lead
        self.excess = np.concatenate([[0], np.cumsum(excess)])  # excess bytes before each exception, and all
        self.chars = lead - self.excess[:-1]

    def to_byte(self, char: int) -> int:
        """Byte position of the character with this code-point position (or of the end)."""
        return char + int(self.excess[np.searchsorted(self.chars, char)])

    def to_char(self, byte: int) -> int:
        """Code-point position of the character that begins at this byte (or of the end)."""
        return byte - int(self.excess[np.searchsorted(self.bytes, byte)])


def _unit_starts(data: np.ndarray) -> np.ndarray:
    """Marks the bytes where units begin: runs of ASCII letters, and every other character alone."""
    letter = _LETTER[data]
    starts = ~letter & ((data & 0xC0) != 0x80)
    if len(data):
        starts[0] = True
        starts[1:] |= letter[1:] & ~letter[:-1]
    return starts


def _place(starts: np.ndarray, counts: np.ndarray, unit: int) -> int:
    """Byte where the unit with this number begins, the end if there is none; only one block is searched."""
    block = int(np.searchsorted(counts, unit, side="right"))
    if block == len(counts):
        return len(starts)
    before = int(counts[block - 1]) if block else 0
    return block * BLOCK + int(np.flatnonzero(starts[block * BLOCK:(block + 1) * BLOCK])[unit - before])


def transform(data: bytes, key: str, plain_percent: int = 10, spm_percent: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and middle (None if plain) and the rearranged text."""
    codes = np.frombuffer(data, dtype=np.uint8)
    starts = _unit_starts(codes)
    counts = np.cumsum(np.add.reduceat(starts, np.arange(0, len(starts), BLOCK), dtype=np.int64)) if len(starts) else np.zeros(0, np.int64)
    n = int(counts[-1]) if len(counts) else 0
    digest = hashlib.sha256(key.encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))
    if not data or h3 % 100 >= 100 - plain_percent or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    low, high = (_place(starts, counts, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    index = ExceptionIndex(codes)
    prefix, middle, suffix = data[:low], data[low:high], data[high:]
    chars = index.to_char(low)
    if h4 % 100 < spm_percent:
        form, out = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, out = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return n, form, chars, index.to_char(high) - chars, out


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged: its marks cannot occur in a text that is not plain, so they are the borders."""
    parts = F.split(output, "<[PSM]>", -1)
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, seed: str = "1",
                   plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row a document: its id, n (units), form, prefix_chars, middle_chars and output.

    Units are runs of ASCII letters and single other characters. The first four 32-bit numbers h1 to h4 of the SHA-256 of
    ``seed:id`` decide: the prefix ends after the smaller of h1 and h2 modulo n + 1 units, the middle after the larger; a share of
    ``plain_percent`` (by h3) stays as it is and ``spm_percent`` of the rest (by h4) puts the suffix first. Units are found on bytes; an index of
    the multibyte characters alone turns byte cuts into code points.

    A null text counts as empty. Empty texts and texts that hold a mark stay plain, with null lengths. A null id hashes as an empty one.
    Repeated rows give equal rows; an empty table gives an empty result. Texts are transformed whole, one at a time; besides the text
    itself a byte or two a byte of it is held, and 24 bytes a multibyte character. Other columns are not read.
    """
    schema = StructType([StructField(doc_id, docs.schema[doc_id].dataType), StructField("n", LongType()), StructField("form", StringType()),
                         StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])
    plain = docs.select(F.col(doc_id), F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("key"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [transform(d.as_py(), k, plain_percent, spm_percent) for k, d in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            n, form, prefix, middle, out = zip(*found, strict=True) if found else ((),) * 5
            return {doc_id: batch.column(0), "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle,
                    "output": pa.array(out, pa.binary()).cast(pa.string())}

        return work

    return map_arrow(plain, make, schema)
