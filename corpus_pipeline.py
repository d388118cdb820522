"""Documents to packed training sequences, in five stages; each works on what the stage before kept.

Columns of documents are carried through as they are, whatever their names: inside a stage they lie in one struct. All stages
take empty tables, null ids, null and empty texts, and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pingtrail.llm import language_id, minhash, packing, quality, suffix_dedup
from pingtrail.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _wrapped(docs: DataFrame) -> DataFrame:
    """``document``, all columns but the text, and ``text``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("document"), "text")


def _unwrapped(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of documents again, those in ``new`` with another content."""
    new = {"text": F.col("text")} | new
    return rows.select(*(new[c].alias(c) if c in new else F.col("document").getField(c).alias(c) for c in columns))


def keep_identified_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop the documents whose language the compression classifier rejects.

    Null and empty texts and those without a letter go. Rows are judged one by one, so repeated rows share their fate and
    null ids do not matter. If nothing can be learned (an empty table, no language given) every document is rejected.
    """
    learned = language_id.learn_languages(docs.select("text", "lang"))
    judged = language_id.identify_language(_wrapped(docs), learned)
    return _unwrapped(judged.where(~F.col("lang_rejected")), docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop the documents that score below 0.3 for quality.

    Null and empty texts have the score of no difference between good and bad. Rows are scored one by one. Without both labels
    nothing can be learned; every score is then 0.5 and all documents stay.
    """
    model = quality.learn_quality(docs.select("doc_id", "text"), table(spark, folder, "labels"))
    scored = quality.score_quality(_wrapped(docs), model, score="score")
    return _unwrapped(scored.where("score >= 0.3"), docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document of smallest id of each group whose sets of five-word shingles are linked at 0.8 or more.

    The id is taken with the text's hash, so that rows of one id but other texts are told apart; of equal rows one stays. Texts
    without words are linked with nothing and stay, each id once.
    """
    text_hash = F.md5(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct("doc_id", text_hash.alias("text_hash")).alias("key"), "text")
    groups = minhash.near_duplicates(keyed, doc_id="key", words=5, percent=80)
    kept = stored(groups.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "pipeline-kept")
    kept = kept.select(F.col("key.doc_id").alias("kept_id"), F.col("key.text_hash").alias("kept_hash"), F.col("rows").alias("kept_rows"))
    found = _wrapped(docs).join(kept, F.col("document.doc_id").eqNullSafe(F.col("kept_id")) & (text_hash == F.col("kept_hash")))
    again = found.where("kept_rows > 1").dropDuplicates(["kept_id", "kept_hash", "text"])
    return _unwrapped(found.where("kept_rows = 1").unionByName(again), docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Remove every byte of strings of 200 bytes that occur more than once; documents stay, if need be with an empty text.

    A null text becomes an empty one. n_chars is counted anew.
    """
    cut = suffix_dedup.remove_repeats(_wrapped(docs), doc_id="document", as_text=True)
    return _unwrapped(cut, docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens.

    A null or empty text is a piece of one token; repeated rows are packed one by one.
    """
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)
    return packing.pack(pieces, 4096)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_identified_languages),
    ("quality", keep_good_quality),
    ("near_dedup", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: No SQL can express the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
