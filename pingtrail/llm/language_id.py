"""Language identification by compression (operator 2)."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from pingtrail.llm.common import map_arrow, sampled_pieces, texts_of, winning_hashes
from pingtrail.llm.compression import compressor, pieces, size_under

LEVEL = -1
# Vowel signs and accents that stand as characters of their own are parts of words.
NOT_WORDS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> bytes:
    """Lower case with every run of characters that are neither letters nor marks as one blank, in UTF-8."""
    return f" {NOT_WORDS.sub(' ', text.lower()).strip()} ".encode()


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", *, texts_per_language: int = 128,
                    bytes_per_text: int = 512) -> dict[str, bytes]:
    """One raw-content dictionary a language, from a bounded sample of labelled rows.

    At most ``texts_per_language`` texts of each language are used and ``bytes_per_text`` bytes of each on average, so
    a dictionary holds 64 KiB at most. They are pieces from anywhere in the whole text, picked by content, and equal
    pieces count once; texts that fit into the dictionary together are learnt whole. Rows with a null language, a
    null text or no letter teach nothing; copies of a text count once. Without any usable row the result is empty.
    """
    usable = docs.where(F.col(text).rlike(r"\p{L}"))
    winners = winning_hashes(usable.select(F.col(lang).alias("label"), F.xxhash64(text).alias("hash")), texts_per_language)
    sample = texts_of(usable, text, winners)
    found = sampled_pieces(sample, folded, texts_per_language * bytes_per_text, "language-pieces")
    return {label: b"".join(parts) for label, parts in sorted(found.items())}


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", *,
                      least_margin: float = 0.002, pred: str = "lang_pred", score: str = "score",
                      margin: str = "margin", rejected: str = "lang_rejected") -> DataFrame:
    """``docs`` with the language whose dictionary encodes the whole text shortest, and the doubt about it.

    The margin is the share of the second smallest encoding that the smallest one saves; the score maps it
    to 0..1 (``1 - exp(-20 * margin)``). Rows are rejected when the text has no letter or the margin is below
    ``least_margin``; the prediction stays, so a caller decides what a rejection does.

    A null, empty or letterless text is ``und`` with score 0 and rejected. Equal sizes go to the first language in
    order of name. With one learned language the margin is measured against the folded text as it is. Without any every
    text is ``und``. Rows are judged one by one: repeated rows, other columns and null ids do not matter. An
    input column of the same name as a new one is replaced.
    """
    new = (pred, score, margin, rejected)
    kept = [c for c in docs.columns if c not in new]
    schema = StructType([docs.schema[c] for c in kept] + [
        StructField(pred, StringType()), StructField(score, DoubleType()), StructField(margin, DoubleType()),
        StructField(rejected, BooleanType())])

    def make():
        from math import exp

        coders = [(label, compressor(content, LEVEL)) for label, content in sorted(dictionaries.items())]

        def judged(value: str | None) -> tuple[str, float, float, bool]:
            if not coders or value is None or not LETTER.search(value):
                return "und", 0.0, 0.0, True
            data = folded(value)
            parts = pieces(data)
            sizes = sorted((size_under(coder, parts), label) for label, coder in coders)
            second = sizes[1][0] if len(sizes) > 1 else max(len(data), sizes[0][0])
            gap = (second - sizes[0][0]) / second
            return sizes[0][1], 1 - exp(-20 * gap), gap, gap < least_margin

        def work(batch: pa.RecordBatch) -> dict:
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
            results = [judged(v) for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return out | dict(zip(new, map(list, zip(*results, strict=True)), strict=True)) if results else out | dict.fromkeys(new, [])

        return work

    return map_arrow(docs.select(*kept), make, schema)
