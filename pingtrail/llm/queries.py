"""One query an operator over its whole intended table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pingtrail.llm import block_topk, bpe, curriculum, fill_in_middle, language_id, minhash, multi_index, packing, quality, suffix_dedup, token_counts, warc, whitening
from pingtrail.llm.common import remainder_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder_of_id("doc_id", 4) == 2, F.lit(False))
    learned = language_id.learn_languages(docs.where(remainder_of_id("doc_id", 4) != 2))
    found = language_id.identify_language(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "lang_rejected")


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.learn_quality(docs.where(remainder_of_id("doc_id", 5) != 0), table(spark, folder, "labels"))
    scored = quality.score_quality(docs, model)
    held_out = F.coalesce(remainder_of_id("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's end goes to the line with most of it."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_by_section(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)
    return packing.pack(pieces, 4096)


@query("op9_minhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


@query("op3_embedding_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_duplicate_vectors(table(spark, folder, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


@query("op5_block_topk", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return block_topk.top_k(table(spark, folder, "embeddings"))


@query("op1_warc")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    back = warc.round_trip(table(spark, folder, "pages"))
    return back.select(warc.number_of("record_id").alias("page_id"), "payload_bytes",
                       F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type",
                       warc.number_of("refers_to").alias("refers_to"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), level AS (  -- the sources whose caps lie below the level, step by step
  SELECT 0 AS step, (SELECT sum(source_size) FROM w)::BIGINT AS free, (SELECT sum(weight) FROM w)::BIGINT AS open
  UNION ALL
  SELECT step + 1, new_free, new_open FROM (
    SELECT l.step, l.free, l.open,
      ((SELECT sum(source_size) FROM w) - (SELECT coalesce(sum(cap), 0) FROM w WHERE cap * l.open <= weight * l.free))::BIGINT AS new_free,
      (SELECT sum(weight) FROM w WHERE cap * l.open > weight * l.free)::BIGINT AS new_open
    FROM level l)
  WHERE new_open < open
), t AS (
  SELECT w.*, CASE WHEN cap * l.open <= weight * l.free THEN cap::DOUBLE ELSE (weight::DOUBLE * l.free::DOUBLE) / l.open::DOUBLE END AS target
  FROM w, (SELECT * FROM level ORDER BY step DESC LIMIT 1) l
), g AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.goal, g.weight, g.rank,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM p
), r AS (
  SELECT *, size * passes + least(greatest(goal - passes * source_size - start, 0), size) AS taken,
    start::DOUBLE / greatest(goal, 1)::DOUBLE * weight AS area, weight * (1 + (rank % 3 - 1) * 0.5::DOUBLE) AS low, weight * (1 - (rank % 3 - 1) * 0.5::DOUBLE) AS high
  FROM q
)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
  CAST(CASE WHEN taken = 0 THEN 0 ELSE passes + CASE WHEN taken > size * passes THEN 1 ELSE 0 END END AS INTEGER) AS readings,
  round(CASE WHEN taken > 0 THEN 2 * area / (low + sqrt(low * low + 2 * (high - low) * area)) END, 9) AS position
FROM r
"""


@query("op11_curriculum", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    mixed = curriculum.curriculum_mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("placements").alias("readings"), F.round("position", 9).alias("position"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    done = whitening.whiten(table(spark, folder, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").cast("long"))
