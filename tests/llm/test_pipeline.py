"""The corpus pipeline, stage by stage, against what each stage's operator is tested to do."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from test_duplicates import brute_minhash, brute_repeats

from pingtrail.llm.common import shared_folder, stored

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}

    kept = stages["language_id"](spark, docs, FOLDER)
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    assert kept.columns == columns and kept.count() >= 0.95 * docs.count()

    good = stages["quality"](spark, kept, FOLDER)
    good = spark.createDataFrame(good.collect(), good.schema)
    ids = {r.doc_id for r in good.collect()}
    clean = [r.doc_id for r in kept.collect() if labels.get(r.doc_id) == 1]
    assert good.columns == columns and sum(i in ids for i in clean) >= 0.97 * len(clean)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = stages["near_dedup"](spark, good, FOLDER)
    one = spark.createDataFrame(one.collect(), one.schema)
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, c in brute_minhash(rows, 5, 80) if d == c)

    cut = stages["suffix_dedup"](spark, one, FOLDER)
    cut = spark.createDataFrame(cut.collect(), cut.schema)
    before = [(r.doc_id, r.text) for r in one.collect()]
    want = {d: h for (d, _), (_, _, _, h) in zip(before, brute_repeats([t.encode() for _, t in before], 200), strict=True)}
    after = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and after.keys() == want.keys()
    assert all(r.n_chars == len(r.text) for r in after.values())
    whole = [d for d, t in before if hashlib.sha256(t.encode()).hexdigest() == want[d]]
    assert all(after[d].text == dict(before)[d] for d in whole)
    assert sum(hashlib.sha256(after[d].text.encode()).hexdigest() == h for d, h in want.items()) >= 0.9 * len(want)

    packed = stages["packing"](spark, cut, FOLDER)
    assert {r.doc_id for r in packed.collect()} == after.keys()


def test_repeated_rows_and_nulls(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (1, "other words that nobody else has written down here", "en", "s", 9),
            (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, FOLDER).collect()
    assert sum(r.text == text for r in kept) == 1 and len(kept) == 4
    cut = corpus_pipeline.cut_repeated_passages(spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in cut) == ["1", "1", "1", "2", "None", "None"]


NAMES = ["kept_rows", "kept_id", "kept_hash", "quality_score", "lang_pred", "score", "margin", "lang_rejected", "key", "document", "kept", "class", "a b"]


def test_columns_of_documents_survive_whatever_their_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name in NAMES:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    names = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "test-clash")
        rows = docs.collect()
        assert docs.columns == names[0].__fields__ and len(rows) > 50
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= len(rows)


def test_empty_table(spark):
    folder = shared_folder(spark, "test-empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_first_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole = docs.where("lang IS NOT NULL").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (900_001, "12 \u00bd !!", "en", "s", 8)], docs.schema)
    both = whole.unionByName(odd).unionByName(whole.limit(1)).unionByName(whole.limit(1))
    first = whole.first().doc_id
    kept = corpus_pipeline.keep_identified_languages(spark, both, FOLDER).collect()
    assert not [r for r in kept if r.doc_id in (None, 900_001)] and sum(r.doc_id == first for r in kept) in (0, 3)
    good = corpus_pipeline.keep_good_quality(spark, both, FOLDER).collect()
    assert sum(r.doc_id == first for r in good) in (0, 3) and sum(r.doc_id is None for r in good) in (0, 2)
    packed = corpus_pipeline.pack_sequences(spark, odd, FOLDER).collect()
    assert sorted(r.length for r in packed)[:2] == [1, 1] and len(packed) == 3


def test_run(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() > 0
