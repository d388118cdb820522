"""Token counts of fields or sections by offset attribution (operator 6)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pingtrail.llm.common import map_arrow
from pingtrail.llm.tokens import OffsetTokenizer, shared

RULES = ("start", "end", "most")


def line_ends(text: str) -> np.ndarray:
    """Ends of the lines of a text, each with its line break; the last line may lack one."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.array(ends, dtype=np.int64)


def attribute(spans: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, for sorted token spans and the sorted ends of adjoining sections.

    Both sides are ordered, so the interval join is two binary searches a token: the sections of its first
    and of its last character. A token within one section counts there. One that crosses a boundary counts by
    ``rule``: ``start`` in the section of its first character, ``end`` in that of its last one, ``most`` in the section that
    holds most of its characters, the earliest of equals.
    """
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(ends, spans[:, 1] - 1, side="right")
    owner = last if rule == "end" else first.copy()
    if rule == "most":
        for i in np.flatnonzero(first != last):
            low, high = spans[i]
            edges = np.concatenate([[low], ends[first[i]:last[i]], [high]])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(ends))


def count_by_section(docs: DataFrame, path: str, text: str = "text", *, rule: str = "most",
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a line of each text: the columns ``keep``, section (from 0), start and end in characters, n_tokens.

    Each text is encoded once as a whole, so the counts of its lines add up to its tokens. Strings like ``<|endoftext|>`` in a
    text are plain text here, not special tokens (packing, whose ids go to a model, finds them). A null or empty text gives
    no row. A line without a token of its own counts 0. Repeated rows give repeated results; columns other than
    ``keep`` and the text are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = StructType([*(docs.schema[c] for c in keep), StructField("section", IntegerType()), StructField("start", LongType()),
                         StructField("end", LongType()), StructField("n_tokens", LongType())])

    def make():
        tokenizer = shared(OffsetTokenizer, path)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            ends = [line_ends(t) for t in texts]
            counts = [attribute(s, e, rule) for s, e in zip(tokenizer.spans(texts), ends, strict=True)]
            sizes = [len(e) for e in ends]
            rows = pa.array(np.repeat(np.arange(len(texts)), sizes))
            every = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
            return {c: batch.column(i).take(rows) for i, c in enumerate(keep)} | {
                "section": every([np.arange(n) for n in sizes]).cast(pa.int32()),
                "start": every([np.concatenate([[0], e[:-1]]) if len(e) else e for e in ends]),
                "end": every(ends), "n_tokens": every(counts)}

        return work

    return map_arrow(docs.select(*keep, text), make, schema)
