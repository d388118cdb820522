"""BPE, token counts and packing against the tokenizer libraries and by conservation."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from pingtrail.llm import bpe, packing, token_counts
from pingtrail.llm.queries import QUERIES
from pingtrail.llm.tokens import OffsetTokenizer, Remembered, WordTokenizer

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["\x1c", "\x85", "\xa0", " ", " ", " ", "\n", "\t", "\r", "​", "́", "İ", "Σ", "ς", "ß", "é", "'s", "'LL", "a", "B",
       "1", "22", "漢", "😀", "!!", "<|endoftext|>", "'", "ﬁ", "ª"]


def odd_texts(n=1500):
    rng = random.Random(3)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(n)]


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_texts(reference):
    coder = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    texts = [*odd_texts(), "", "a" * 50_000, "".join(random.Random(1).choices("abcdefgh", k=50_000)), " " * 3000 + "x"]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_takes_smaller_ranks_that_come_up_later():
    """Ranks where a merge brings up a pair of smaller rank than itself."""
    ranks = {bytes([b]): b + 1000 for b in range(97, 101)} | {b"bc": 50, b"abc": 3, b"bcbc": 7, b"dbc": 60, b"cd": 90}
    own = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Encoder(ranks, r"\S+")
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(800)]
    assert [i.tolist() for i in coder.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_rank_queue_order():
    queue = bpe.RankQueue()
    ranks = random.Random(0).sample(range(50_000), 500)
    for position, rank in enumerate(ranks):
        queue.add(rank, position)
    assert [queue.take()[0] for _ in ranks] == sorted(ranks) and queue.take() is None


def test_bpe_query(spark, reference):
    found = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, FOLDER).collect()}
    for doc_id, text in documents(spark).items():
        ids = reference.encode_ordinary(text)
        assert tuple(found[doc_id])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                            hashlib.sha256(text.encode()).hexdigest())


def test_bpe_odd_rows(frame):
    docs = frame([(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "", 3)], "doc_id long, text string, ids int")
    found = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), len(r.ids), bytes(r.decoded)) for r in found) == [
        ("1", 0, b""), ("1", 0, b""), ("2", 0, b""), ("None", 2, b"a b")]
    assert bpe.encode_and_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_piecewise_tokenizers_equal_whole_texts(spark):
    texts = odd_texts() + list(documents(spark).values())
    words, own = WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    own.encode_special_tokens = True
    assert all(np.frombuffer(words.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids for t in texts)
    offsets, own = OffsetTokenizer(BYTES), Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    assert all(s.tolist() == [list(o) for o in own.encode(t, add_special_tokens=False).offsets] for t, s in zip(texts, offsets.spans(texts), strict=True))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_rules(rule):
    rng = random.Random(2)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, 40), rng.randint(0, 6))) + [40]
        tokens, at = [], 0
        while at < 40:
            end = min(40, at + rng.randint(1, 7))
            tokens.append((at, end))
            at = end
        want = [0] * len(cuts)
        section = [next(i for i, c in enumerate(cuts) if p < c) for p in range(40)]
        for a, b in tokens:
            inside = section[a:b]
            want[inside[0] if rule == "start" else inside[-1] if rule == "end" else max(sorted(set(inside)), key=inside.count)] += 1
        assert token_counts.attribute(np.array(tokens), np.array(cuts), rule).tolist() == want


def test_token_counts_query(spark):
    found = QUERIES["op6_token_counts"](spark, FOLDER).collect()
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    totals, covered = {}, {}
    for r in found:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
        covered.setdefault(r.doc_id, []).append((r.section, r.start, r.end))
    for doc_id, text in documents(spark).items():
        assert totals.get(doc_id, 0) == len(own.encode(text, add_special_tokens=False).ids)
        assert [text[a:b] for _, a, b in sorted(covered.get(doc_id, []))] == text.splitlines(keepends=True) or "\n" not in text or \
            "".join(text[a:b] for _, a, b in sorted(covered[doc_id])) == text


def test_token_counts_odd_rows(frame):
    docs = frame([(None, "a\n\n\n\nb", 1), (1, None, 2), (2, "", 3), (3, "x\ny", 0), (3, "x\ny", 0)], "doc_id long, text string, section int")
    found = [tuple(r) for r in token_counts.count_by_section(docs, BYTES).collect()]
    assert {r[0] for r in found} == {None, 3} and sum(r[0] == 3 for r in found) == 4
    assert [r[1:4] for r in sorted(f for f in found if f[0] is None)] == [(0, 0, 2), (1, 2, 3), (2, 3, 4), (3, 4, 5), (4, 5, 6)]
    assert token_counts.count_by_section(docs.limit(0), BYTES).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_by_section(docs, BYTES, rule="half")


def test_token_counts_read_special_tokens_as_text(frame):
    texts = ["a <|endoftext|> b\n<|endoftext|>", "<|endoftext|>"]
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    found = token_counts.count_by_section(frame(list(enumerate(texts)), "doc_id long, text string"), BYTES).collect()
    for i, text in enumerate(texts):
        assert sum(r.n_tokens for r in found if r.doc_id == i) == len(own.encode(text, add_special_tokens=False).ids) > 3


def test_memories_are_bounded_by_bytes():
    memory = Remembered(1 << 20)
    for i in range(50_000):
        memory.put(f"key {i}", b"x" * 40)
        memory.put("long " * 100 + str(i), b"x" * 40)
    assert 1000 < len(memory.young) + len(memory.old) <= (1 << 20) // Remembered.ENTRY and memory.get("key 49999") and not memory.get("key 1")
    words, bytes_ = WordTokenizer(WORDS), bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60_000))
        words.encode(text)
        bytes_.encode([text])
    held = [words.pieces, words.parts, bytes_.pieces, bytes_.pretokens]
    assert sum(len(k) for m in held for half in (m.young, m.old) for k in half) < 3_000_000


def test_merges_of_long_pretokens_in_parts(monkeypatch):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    monkeypatch.setattr(bpe, "MERGED_BYTES", 300)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcé日", k=n)) for n in (10, 250, 290, 3000, 40)] + ["a" * 1500, "word other words " * 30]
    assert [list(ids) for ids in bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN).encode(texts)] == [own.encode_ordinary(t) for t in texts]


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_query(spark):
    rows = QUERIES["op7_packing"](spark, FOLDER).collect()
    own = Tokenizer.from_file(WORDS)
    want = {}
    for doc_id, text in documents(spark).items():
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[doc_id, k] = at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert check_packing(rows, 4096) <= 1.01 * math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_plan_uses_every_length_once():
    rng = random.Random(4)
    for _ in range(30):
        capacity = rng.randint(5, 60)
        counts = {n: rng.randint(1, 300) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        used, sequences = {}, 0
        for members, n in packing.plan_sequences(counts, capacity):
            assert n > 0 and sum(length * copies for length, copies in members) <= capacity
            sequences += n
            for length, copies in members:
                used[length] = used.get(length, 0) + n * copies
        assert used == counts
        first_fit = sum(counts.values())
        assert math.ceil(sum(k * v for k, v in counts.items()) / capacity) <= sequences <= first_fit


def test_plan_takes_exact_complements():
    assert len(packing.plan_sequences({7: 1, 3: 1}, 10)) == 1
    assert sum(n for _, n in packing.plan_sequences({6: 2, 3: 2, 1: 2}, 10)) == 2
    assert sum(n for _, n in packing.plan_sequences({4: 5, 3: 5, 2: 5, 1: 5}, 10)) == 5


def test_pack_odd_rows(frame):
    rows = [(None, 0, 0, 5, 1, "x"), (1, 0, 0, 5, 1, "y"), (1, 0, 0, 5, 1, "y"), (2, 0, 0, 10, 1, None)]
    pieces = frame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, offset string")
    found = packing.pack(pieces, 10).collect()
    assert check_packing(found, 10) == 3 and len(found) == 4
    assert packing.pack(pieces.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces, 9)


def test_pack_numbers_rows_of_one_length_over_cells(frame, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CELL", 7)
    pieces = frame([(i, 0, 0, 4, i) for i in range(101)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert check_packing(packing.pack(pieces, 13).collect(), 13) == math.ceil(101 / 3)


def test_pack_deals_equal_rows_over_cells(frame, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CELL", 10)
    made = {}
    real = packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, name: made.setdefault(name, real(df, name)))
    pieces = frame([(None, 0, 0, 1, 7)] * 400, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = packing.pack(pieces, 16).collect()
    assert check_packing(found, 16) == 25 and len(found) == 400
    cells = made["pieces"].groupBy(F.pmod(F.xxhash64(packing.ROW), F.lit(40)).alias("cell")).count().collect()
    assert len(cells) > 35 and max(r["count"] for r in cells) < 30


def test_packing_finds_special_tokens_in_texts(frame):
    own, rng = Tokenizer.from_file(WORDS), random.Random(5)
    texts = ["see <|endoftext|> here x<|startoftext|>y", "<|endoftext|><|endoftext|>", "<|EndOfText|> A<|endoftext|>!!", "<|endoftext|", *odd_texts(300)]
    texts += ["".join(rng.choices([*ODD, "<|startoftext|>", "<|", "|>"], k=12)) for _ in range(300)]
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.token_pieces(docs, WORDS, 4096, with_ids=True).collect()
    want = {i: [*own.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in found} == want and {49406, 49407} <= set(want[0])
