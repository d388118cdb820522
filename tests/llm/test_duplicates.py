"""Near and exact duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pingtrail.llm import minhash, multi_index, suffix_dedup
from pingtrail.llm.common import components

LOWER = {c: c + 32 for c in range(65, 91)}


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_minhash(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    groups = Union(len(rows))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(groups.find(i), []).append(doc_id)
    return sorted((d, len(s), min(least[groups.find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_components_against_union_find(frame):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], [(5, i) for i in range(40)]):
        groups = Union(100)
        for a, b in edges:
            groups.join(a, b)
        found = {r.node: r.root for r in components(frame(edges, "a long, b long")).collect()}
        assert found == {x: groups.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(frame([], "a long, b long")).count() == 0


def test_minhash_with_near_copies(frame):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(8):
        text = rng.choices(words, k=rng.choice([4, 12, 60, 200]))
        for _ in range(14):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 % 113 + 200 * base, " ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy)))
    rows += [(5001, "one"), (5002, "ONE"), (5003, "one two"), (5004, "one  two\n"), (5005, "two one")]
    for k, percent in ((3, 85), (5, 80)):
        found = minhash.near_duplicates(frame(rows, "doc_id long, text string"), words=k, percent=percent).collect()
        assert sorted(tuple(r)[:3] for r in found) == brute_minhash(rows, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_minhash_odd_rows(frame):
    docs = frame([(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "", 0), (None, "a b c d", 0), (7, "a b c d", 0), (7, "a b c d", 0), (9, "x " * 80_000, 1)],
                 "doc_id long, text string, component_id int")
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=3, percent=85).collect())
    assert found == [("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 0, 4, True), ("7", 2, 7, True), ("7", 2, 7, True),
                     ("9", 1, 9, True), ("None", 2, 7, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            pool = rng.integers(0, 2 ** 63, 600).astype(np.uint64)
            both = int(600 * share)
            cut = both + (600 - both) // 2
            a, b = minhash.signature(pool[:cut], 160), minhash.signature(np.concatenate([pool[:both], pool[cut:]]), 160)
            errors.append((a == b).mean() - both / 600)
        assert abs(np.mean(errors)) < 0.02


def brute_vectors(rows, cosine):
    n = len(rows)
    links, groups = [0] * n, Union(n)
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not a or not b or len(a) != len(b) or None in a or None in b:
                continue
            a, b = np.array(a, float), np.array(b, float)
            if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        least[groups.find(i)] = min(least.get(groups.find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[groups.find(i)]) for i, r in enumerate(rows))


def test_vectors_against_brute_force(frame, monkeypatch):
    monkeypatch.setattr(multi_index, "PER_CELL", 8)
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for base in rng.normal(size=(25, 12)):
        for _ in range(rng.integers(1, 18)):
            rows.append((len(rows), (base + rng.normal(size=12) * 0.09).astype(float).tolist(), int(len(rows) % 2)))
    rows += [(len(rows) + i, [1.0] * 12, 3) for i in range(60)]  # one vector many times
    inf, nan = float("inf"), float("nan")
    for odd in (None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [nan] * 12, [inf] + [1.0] * 11, [1.0] * 5, [2.0] * 5):
        rows.append((len(rows), odd, 3))
    rows.append((len(rows), [1.0] * 12, None))
    found = multi_index.near_duplicate_vectors(frame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = brute_vectors(rows, 0.98)
    got = sorted(tuple(r)[:3] for r in found)
    assert len(got) == len(want) and sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vectors_empty_table(frame):
    assert multi_index.near_duplicate_vectors(frame([], "vec_id long, embedding array<float>, label int, kept int")).count() == 0


def test_multi_sequence_order():
    index = multi_index.MultiIndex(np.zeros((6, 1)), np.zeros((5, 1)), 1.1)
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    cells = index.visits(a - a.min(), b - b.min())
    cost = [(a - a.min())[c // 5] + (b - b.min())[c % 5] for c in cells]
    every = ((a - a.min())[:, None] + (b - b.min())[None]).ravel()
    assert cost == sorted(cost) and sorted(cells) == np.flatnonzero(every <= 1.1).tolist()


def brute_repeats(texts, window):
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                covered[i:i + window] = b"\1" * window
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        runs = sum(1 for i in range(len(t)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(df):
    done = df.select("doc_id", "n_bytes", F.octet_length("kept").alias("k"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")).collect()
    return {r.doc_id: (r.n_bytes, r.n_bytes - r.k, r.s, r.h) for r in done}


def test_repeats_against_brute_force(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 16)
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh ", k=900)) for _ in range(6)]
    texts = []
    for k in range(60):
        source, at = rng.choice(base), rng.randint(0, 500)
        texts.append("".join(rng.choices("abc é", k=rng.randint(0, 80))) + source[at:at + rng.randint(150, 400)]
                     + "".join(rng.choices("abcü", k=rng.randint(0, 80))) + (rng.choice(base)[:250] if k % 3 == 0 else ""))
    texts += ["a" * 1000, "ab" * 500, "é" * 400, "", None, "x" * 199, "y" * 200, "z" * 201, texts[0], texts[0], "q" + base[0][:199], base[0][:200] + "q"]
    df = frame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    found = repeats(suffix_dedup.remove_repeats(df))
    assert [found[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts], 200)


def test_large_buckets_are_split_by_content(spark, frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 64)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 500)
    made = {}
    real = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: made.setdefault(name, real(df, name)))
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=420))
    texts = []
    for k in range(3000):  # one passage in all texts, with other words around it, cut at either end in some
        a, b = (rng.randint(0, 60), rng.randint(300, 420)) if k % 3 else (0, 420)
        texts.append("".join(rng.choices("abcd", k=rng.randint(20, 90))) + passage[a:b] + "".join(rng.choices("abcd", k=rng.randint(20, 90))))
    texts += ["-" + passage[40:239], "-" + passage[40:241], passage[:199], "x" * 180 + passage[:20]]
    found = repeats(suffix_dedup.remove_repeats(frame(list(enumerate(texts)), "doc_id long, text string")))
    assert [found[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 200)
    rounds = [df for name, df in made.items() if name.startswith("suffix-parts")]
    contexts = made["suffix-contexts"].where("large").count()
    assert 2 <= len(rounds) <= 9 and contexts > 3000
    assert rounds[0].count() <= 2 * contexts and sum(df.count() for df in rounds) <= 9 * contexts
    assert made["suffix-windows"].count() <= 2 * contexts


def test_periodic_texts_give_few_rows(frame, monkeypatch):
    made = {}
    real = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: made.setdefault(name, real(df, name)))
    texts = ["a" * 5000, "-=" * 2500, "0" * 300 + "b" + "0" * 300, "a" * 199 + "c"]
    found = repeats(suffix_dedup.remove_repeats(frame(list(enumerate(texts)), "doc_id long, text string")))
    assert [found[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 200)
    assert made["suffix-runs"].count() < 500


def test_runs_in_small_slices(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefgh ", k=2000))
    texts = [base, base[300:900] + "?", "!" + base[1500:], base, "", None, base[:250]]
    found = repeats(suffix_dedup.remove_repeats(frame(list(enumerate(texts)), "doc_id long, text string")))
    assert [found[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts], 200)


def test_repeats_in_texts_longer_than_a_chunk(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1500)
    rng = random.Random(2)
    long = "".join(rng.choices("abcd", k=9000))
    texts = [long, "x" + long[1200:1900] + "y", long[4000:4199], "u" + long[7000:7200]]
    found = repeats(suffix_dedup.remove_repeats(frame(list(enumerate(texts)), "doc_id long, text string")))
    assert [found[i] for i in range(4)] == brute_repeats([t.encode() for t in texts], 200)


def test_repeats_odd_rows(frame):
    df = frame([(None, "t" * 300), (1, "s" * 10)], "doc_id long, text string")
    assert repeats(suffix_dedup.remove_repeats(df))[None][:3] == (300, 300, 1)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    cut = suffix_dedup.remove_repeats(frame([(1, "é" + "a" * 250), (2, "ê" + "a" * 250 + "b")], "doc_id long, text string"), as_text=True)
    assert {r.doc_id: r.kept for r in cut.collect()} == {1: "é", 2: "êb"}


def test_difference_cover_and_classes():
    assert all((r + suffix_dedup.SHIFT[r, q]) % 13 in suffix_dedup.COVER and (q + suffix_dedup.SHIFT[r, q]) % 13 in suffix_dedup.COVER
               for r in range(13) for q in range(13))
    rng = random.Random(1)
    for _ in range(25):
        middle = [b"x" * 260, (b"abc" * 100)[:240], bytes(rng.choices(b"ab", k=230))]
        contexts = [bytes(rng.choices(b"ab", k=rng.randint(0, 5))) + rng.choice(middle) for _ in range(12)]
        counts, bucket = np.array([len(c) - 199 for c in contexts]), np.array(sorted(rng.randint(0, 2) for _ in contexts))
        names = {}
        for o, i, c in zip(*suffix_dedup.repeated_windows(contexts, counts, bucket, 200), strict=True):
            names.setdefault((bucket[o], contexts[o][i:i + 200]), set()).add(int(c))
        assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)
