"""Whitening, repeated passages and spelling variants against brute force, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vivarium.llm import packing, queries, repeats, spelling, url_filter, warc, whitening
from vivarium.llm.common import stage

SF = "/root/testdata/sf0.001"


def whitened(found):
    rows = sorted(found.collect(), key=lambda r: (r.vec_id, r.component))
    return rows, np.array([r.whitened for r in rows])


def test_whitening_is_that_of_the_dense_covariance(spark):
    got, white = whitened(queries.op11_whitening(spark, SF))
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 100_000
    n, d = x.shape
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    value, vector = value[::-1], vector[:, ::-1]
    want = (x - x.mean(0)) @ vector[:, :8] / np.sqrt(value[:8])
    white = white.reshape(n, 8)
    assert np.allclose(white * np.sign((white * want).sum(0)), want, atol=1e-7)
    sums = x.sum(0)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)) for v in x]
    assert [r.deviation for r in got[::8]] == deviation and {r.n for r in got} == {n}
    assert np.allclose([r.explained for r in got[:8]], value[:8] / value.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-9 and [r.component for r in got[:8]] == list(range(1, 9))


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 0.0]), (2, [0.1, 0.9, 0.0]), (None, [0.3, 0.3, 0.0]), (4, [0.1, 0.9, 0.0]), (4, [0.1, 0.9, 0.0])]
    rows += [(5, None), (6, []), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [None, 0.0, 0.0]), (10, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("component", F.lit(9))
    got = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, 2: 2, None: 2, 4: 4}  # the third dimension is constant
    assert max(r.identity_error for r in got) < 1e-9 and math.isclose(sum({r.component: r.explained for r in got}.values()), 1)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 4")).count() == 0  # all alike: nothing to whiten
    huge = spark.createDataFrame([(1, [4e9]), (2, [-4e9]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(huge).orderBy("vec_id").collect()] == [None, None, 0]


def test_iteration_resolves_close_values():
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    values = np.r_[10, 9.99, 9.98, 5, 5, 4, 3, 2.9, np.linspace(2.5, 0.1, 292)]
    matrix = (basis * values) @ basis.T
    found, vectors, passes = whitening.iterate(lambda q: matrix @ q, 300)
    assert np.allclose(found, values[:8], rtol=1e-11) and 1 < passes < 120
    assert np.allclose(np.abs((basis[:, :3] * vectors[:, :3]).sum(0)), 1)


def brute_repeats(texts):
    n = repeats.LENGTH
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - n + 1):
            if often[d[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def assert_repeats(spark, texts, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.cut_repeats(df).collect()}
    for i, want in enumerate(brute_repeats(texts)):
        assert (*got[i][:4], bytes(got[i][4])) == want, i


def edited(rng, text, often):
    words = text.split(" ")
    for _ in range(often):
        words[rng.randrange(len(words))] = rng.choice(["x", "né", "zzz", ""])
    return " ".join(words)


def test_repeats_are_those_of_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base, passage = [make(400) for _ in range(6)], make(45)
    texts = [*base, *(edited(rng, rng.choice(base), rng.choice([1, 3, 20])) for _ in range(30)), *(make(60) for _ in range(10))]
    for i in range(25):  # a passage in many contexts, cut at each end, so that it is at times just too short
        texts.append(make(30) + passage[rng.randrange(30) : len(passage) - rng.randrange(30)] + make(30))
    texts += ["a" * 199, "a" * 199, "b" * 200, "b" * 201, "cd" * 300, "é" * 150, None, "", "short", make(200)[:200], base[0], base[0]]
    window = make(80)[:200]
    texts += [window, "1" + window + "2", "3" + window[1:] + "4" + window[:199]]
    assert_repeats(spark, texts)


def test_repeats_of_two_letters_and_at_step_ends(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda k: "".join(rng.choice("ab") for _ in range(k))
    base = make(3000)
    texts = [base, make(40) + base[500:1400] + make(40), base[:1500] + make(1) + base[1500:], make(700), base[2700:] + base[:300], "a" * 700 + make(100)]
    assert_repeats(spark, texts)
    monkeypatch.setattr(repeats, "STEP", 613)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert len(repeats.anchors_of(data, np.ones(len(data) - repeats.LENGTH + 1, bool))[0]) > 10


def test_repeats_across_rows_of_one_key_and_odd_rows(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, text, "x"), (1, text, "y"), (None, text[:300], None), (None, None, "x"), (3, "", "x"), (4, long, "x"), (5, long[599_900:600_150], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").withColumn("k1", F.lit("k")).withColumn("data", F.lit(1))
    got = sorted((tuple(r)[:4] for r in repeats.cut_repeats(df, with_bytes=False).collect()), key=str)
    want = [(1, 900, 900, 1), (1, 900, 900, 1), (3, 0, 0, 0), (4, 1_500_000, 250, 1), (5, 250, 250, 1), (None, 0, 0, 0), (None, 300, 300, 1)]
    assert got == sorted(want, key=str)
    assert repeats.cut_repeats(df.limit(0)).count() == 0


def test_anchors_do_not_depend_on_steps():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = repeats.anchors_of(data, np.ones(4801, bool))
    at = lambda found: {s: a for a, lo, hi in zip(*(x.tolist() for x in found[:3])) for s in range(lo, hi + 1)}
    parts = {}
    for begin in range(0, 4801, 700):
        part = data[begin : begin + 899]
        parts |= {s + begin: a + begin for s, a in at(repeats.anchors_of(part, np.ones(len(part) - 199, bool))).items()}
    assert parts == at(whole)


@pytest.mark.parametrize("width", [1, 3, 7, 20])
def test_sliding_least(width):
    keys = np.random.default_rng(width).integers(0, 99, 20).astype(np.uint64)
    assert repeats.sliding_least(keys, width).tolist() == [min(keys[i : i + width].tolist()) for i in range(21 - width)]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def typos(rng, words, count):
    out = []
    for _ in range(count):
        w = rng.choice(words)
        i, c = rng.randrange(len(w)), rng.choice("abÀÿé")
        out.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, c + w, w]))
    return out


@pytest.mark.parametrize("most", [2, 6, 500])
def test_spelling_variants_are_those_of_brute_force(spark, most):
    rng = random.Random(most)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) for _ in range(40)] + ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    words += ["stationary" + c for c in "abcdefghij"] + ["pre" + c + "fixed" for c in "abcdefghijklm"] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    rows = [(i, " ".join(typos(rng, words, 60))) for i in range(30)]
    rows += [(100 + i, " ".join(words[i : i + 40] * 3)) for i in range(0, 100, 20)] + [(200, "STATIONARYA, stationaryÀ " * 2)]
    rows += [(300 + i, "chaining chaininga chaininga " + "chainings " * 80 + "chainingaa " * (i < 2) + "chaininga " * 3) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spelling.spelling_variants(df, most=most).collect()}
    want = brute_variants(rows)
    assert got == want and any(r[2] != r[1] for r in want if r[1]) and len(want) > 150


def test_spelling_of_odd_rows(spark, monkeypatch):
    rows = [(None, "wonderful wonderful"), (None, "wonderful wonderful"), (2, None), (3, ""), (4, "Wonderfull, WONDERFULL short"), (5, "wonderful-" * 30), (6, "x" * 9000 + " " + "y" * 9000 + " wonderful" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("k") for c in ("key", "word", "n", "s")})
    assert {tuple(r) for r in spelling.spelling_variants(df).collect()} == brute_variants(rows)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    text = "one wonderful day " * 50 + "a" * 300 + " end"
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "CHARS_PER_STEP", 37)
    assert spelling.runs_of(text) == whole


def test_each_pair_of_a_block_comes_once():
    words = ["".join(p) for p in __import__("itertools").product("ab", repeat=4)] + ["".join(p) for p in __import__("itertools").product("ab", repeat=5)]
    found = Counter()
    for s in (4, 5):
        for front, back, tail in ((s // 2, 0, True), (0, s - s // 2, False)):
            blocks = {}
            for w in words:
                if len(w) in (s, s + 1):
                    blocks.setdefault((w[:front], w[len(w) - back :]), []).append(w)
            for block in blocks.values():
                found.update(tuple(sorted(p)) for p in spelling.pairs_of(block, s, front, back, tail))
    assert set(found.values()) == {1}
    assert set(found) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_equal_rows_go_to_different_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 500)
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).repartition(3)
    cut = stage(packing.pieces(rows), "pieces")
    sizes = sorted(r["count"] for r in packing.in_parts(cut, {1: 5000}).groupBy("part").count().collect())
    assert len(sizes) == 10 and sizes[0] > 350 and sizes[-1] < 650
    got = packing.pack(rows).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000 and len({r.sequence_id for r in got}) == 2


def test_inflation_is_bounded():
    import gzip
    import io

    data = b"a" * 30_000_000 + b"end"
    packed = gzip.compress(data) + gzip.compress(b"") + gzip.compress(b"more" * 500_000)
    blocks = list(warc.inflated(io.BytesIO(packed)))
    assert max(map(len, blocks)) <= 1 << 20 and b"".join(blocks) == data + b"more" * 500_000


def test_url_sample_does_not_depend_on_files(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(pages.filter("page_id % 5 = 0"))
    score = lambda df: sorted(((r.page_id, r.url_, r.block_score) for r in url_filter.judge(df, train_rows=150).withColumn("url_", F.col("path")).collect()), key=str)
    one, many = score(pages.coalesce(1)), score(pages.repartition(7))
    assert one == many and any(r[2] is not None for r in one)
