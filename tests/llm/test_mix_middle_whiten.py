"""Curriculum mixing, fill-in-the-middle and whitening against brute force, and their odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pingtrail.llm import curriculum, fill_in_middle as fim, whitening
from pingtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def brute_targets(sizes, weights, most):
    """Shares by weight in exact fractions; who is above the cap is set to it and the rest is shared again."""
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        free = {s: Fraction(weights[s]) for s in sizes if s not in fixed}
        left = total - sum(fixed.values())
        shares = {s: left * w / sum(free.values()) for s, w in free.items() if sum(free.values())}
        over = [s for s in free if s not in shares or shares[s] >= most * sizes[s]]
        if not over:
            return {s: float(v) for s, v in (fixed | shares).items()}
        fixed |= {s: Fraction(most * sizes[s]) for s in over}


def test_targets_and_taken(frame):
    rng = np.random.default_rng(1)
    names = ["é", "b", "a", "Z", None, "𝔸", "", "tiny", "none"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), names[0] if i % 3 == 0 else names[int(rng.integers(0, 7))]) for i in range(900)]
    rows += [(10_000, "only one", "tiny"), (10_001, None, "none"), (10_002, "", "none"), (None, "a b c", "b"), (None, "a b c", "b"), (5, rows[5][1], rows[5][2])]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    docs = frame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    mixed = curriculum.curriculum_mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in mixed) == Counter((d, len((t or "").split()), s) for d, t, s in rows)
    taken = defaultdict(int)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.placements) and len(r.placements) <= 3
        assert (r.position is None) == (not r.placements) and all(0 <= p.position < 1 for p in r.placements)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    at = [r.position for r in mixed]
    assert at == sorted(at, key=lambda p: (p is None, p or 0.0))
    assert mixed == curriculum.curriculum_mix(docs.repartition(5)).collect()


def test_positions_follow_the_schedule(frame):
    docs = frame([(i, "x", "ab"[i % 2]) for i in range(4000)], DOCS)

    def schedule(rank):  # the first source only in the first half and last tenth, the second all the time, with a jump
        knots = [[(0.0, 2.0), (0.5, 2.0), (0.5, 0.0), (0.9, 0.0), (0.9, 1.0), (1.0, 1.0)], [(0.0, 1.0), (1.0, 1.0)]]
        arrays = [F.array(*(F.struct(F.lit(t).alias("time"), F.lit(w).alias("weight")) for t, w in k)) for k in knots]
        return F.when(rank == 0, arrays[0]).otherwise(arrays[1])

    mixed = curriculum.curriculum_mix(docs, schedule=schedule, total=3000)
    assert {r.source: r.target for r in mixed.collect()} == pytest.approx({"a": 3000 * 1.1 / 2.1, "b": 3000 / 2.1})
    read = curriculum.training_order(mixed).join(docs, "doc_id").collect()
    a, b = (np.sort([r.position for r in read if r.source == s]) for s in "ab")
    assert ((a < 0.5) | (a >= 0.9)).all() and abs((a < 0.5).mean() - 1 / 1.1) < 0.002
    assert np.abs(b - np.arange(len(b)) / len(b)).max() < 0.001
    order = [r.position for r in curriculum.training_order(mixed).collect()]
    assert order == sorted(order)


def test_mix_of_many_equal_rows_and_of_nothing(frame, monkeypatch):
    monkeypatch.setattr(curriculum, "REPEATS", 7)
    mixed = curriculum.curriculum_mix(frame([(1, "a b", "s")] * 50 + [(2, "c", "t")], DOCS)).collect()
    assert len(mixed) == 51 and sum(r.taken for r in mixed) in (100, 101, 102)
    assert len({r.placements[0].position for r in mixed if r.source == "s" and r.placements}) == sum(bool(r.placements) for r in mixed if r.source == "s")
    assert curriculum.curriculum_mix(frame([], DOCS)).collect() == []
    empty = curriculum.curriculum_mix(frame([(1, None, None), (2, "", "s")], DOCS)).collect()
    assert [(r.size, r.target, r.taken, r.position) for r in empty] == [(0, 0.0, 0, None)] * 2


def test_mix_uses_built_in_functions_only(spark, frame):
    mixed = curriculum.curriculum_mix(frame([(1, "a b", "s")], DOCS))
    assert not re.search("Python|Arrow|Pandas", mixed._jdf.queryExecution().executedPlan().toString())


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), out


ODD = ["", None, "a", "é", "<", "<P", "P>x<S", "a<M>b", "日本語 text — ümlaut 𝔸𝔹 é", "\x00\r\n\t", "x" * 300_000, "é𝔸a " * 60_000, "<<<>>>SPM" * 9]


def test_middle_against_plain_python(frame):
    rows = [(i * len(ODD) + k, t) for i in range(6) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "same"), (3, "same")]
    docs = frame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1))
    done = fim.fill_in_middle(docs)
    found = done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted((brute_middle(*r) for r in rows), key=key)
    assert Counter((r.doc_id, r.back) for r in found) == Counter((d, t or "") for d, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abZ<PSM> \n"), st.characters(codec="utf-8"))), st.integers(0, 10**6))
def test_middle_of_any_text(text, doc_id):
    n, form, prefix, middle, out = fim.transform(text.encode(), f"1:{doc_id}")
    assert (doc_id, n, form, prefix, middle, out.decode()) == brute_middle(doc_id, text)


@given(st.text(alphabet=st.characters(codec="utf-8")))
def test_exception_index(text):
    data = text.encode()
    index = fim.ExceptionIndex(np.frombuffer(data, dtype=np.uint8))
    assert len(index.bytes) == sum(ord(c) > 127 for c in text)
    for i in range(len(text) + 1):
        at = len(text[:i].encode())
        assert index.to_byte(i) == at and index.to_char(at) == i


def brute_whitened(vectors, weights="counts", k=8):
    x = np.floor(1024 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, ((x - sums / n) @ axes / np.sqrt(values))[:, :k], (values / values.sum())[:k]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_against_numpy(frame, weights):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(150, 12)) * np.linspace(0.2, 2, 12)).astype(np.float32).tolist()
    vectors = base + [base[0]] * 80 + base[:5]  # one vector is a third of all
    bad = [None, [], [1.0] * 11 + [float("nan")], [1.0] * 11 + [float("inf")], [1.0] * 11 + [None]]
    rows = [(i if i else None, v, "clash") for i, v in enumerate(vectors + bad)] + [(1, vectors[1], "clash")]
    done = whitening.whiten(frame(rows, "vec_id long, embedding array<float>, component string"), weights=weights).collect()
    good = vectors + [vectors[1]]
    n, deviation, y, share = brute_whitened(good, weights)
    assert len(done) == 8 * len(good) and {r.n for r in done} == {n} and len({r.identity_error for r in done}) == 1
    assert max(r.identity_error for r in done) < 1e-9
    signs = {}
    for r in done:
        i = r.vec_id or 0
        assert r.deviation == Decimal(deviation[i]) and r.explained == pytest.approx(share[r.component - 1], rel=1e-10)
        sign = signs.setdefault(r.component, np.sign(r.whitened) * np.sign(y[i, r.component - 1]))
        assert r.whitened == pytest.approx(sign * y[i, r.component - 1], abs=1e-8)
    assert Counter((r.vec_id, r.component) for r in done)[1, 1] == 2


def test_whitening_of_degenerate_tables(frame):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(frame(rows, schema)).collect() == []
    line = whitening.whiten(frame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 1.0])], schema)).collect()
    assert {r.component for r in line} == {1} and sorted(abs(round(r.whitened, 6)) for r in line) == [0.0, 1.224745, 1.224745]
    wide = whitening.whiten(frame([(1, [0.0, 1e6]), (2, [1e9, 3.0])], schema)).collect()
    assert {r.deviation for r in wide} == {Decimal((1024 * 10**9) ** 2 + (1024 * (10**6 - 3)) ** 2)}
    with pytest.raises(ValueError):
        whitening.whiten(frame([(1, [0.0, 1.0]), (2, [1.0])], schema))


def test_queries_of_these_operators(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op12_fill_in_middle"](spark, FOLDER).collect():
        want = brute_middle(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[1:5]
        assert r.output_sha256 == hashlib.sha256(want[5].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    n, deviation, y, share = brute_whitened([v for _, v in rows])
    at = {i: k for k, (i, _) in enumerate(rows)}
    for r in QUERIES["op13_whitening"](spark, FOLDER).collect():
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and r.identity_error < 1e-4
        assert abs(r.whitened) == pytest.approx(abs(y[at[r.vec_id], r.component - 1]), abs=1e-7)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
