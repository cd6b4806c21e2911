"""Sentence pieces, integer clusters and periodic runs against the library, brute force and SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import sentencepiece

from quiverlake.llm import clusters, periods, pieces, registry

SCHEMA = "doc_id long, text string, id string, ids array<int>, decoded string, runs int, mark string"


def _texts():
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma,", "délta", "漢字", "x" * 90, "<s>", "</s>", "<0x0A>", "don't", "12", "▁", "  "]
    prose = " ".join(rng.choice(words) for _ in range(3000))
    return [
        None, "", " ", "   ", "▁▁ a", "one", " lead", "tail ", "a\n\nb\t\tc", "😀é\x85\xa0\x1c\x00", "a" * 5000, " " * 3000 + "x", "ab" * 3000, prose, prose,
        "go " * 500, "a b c " * 200 + "z", "İSTANBUL Σas ﬁ½", "".join(rng.choice("abcdefghij0123456789=-") for _ in range(20_000)),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * 3 - 6, t, "i", [k], "own", k, "m") for k, t in enumerate(_texts())]
    rows += [rows[5], (None, "null id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


# -- 11 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_BPE)


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_pieces_equal_library(request, library, name):
    df = request.getfixturevalue(name)
    rows = pieces.encode_and_decode(df, registry.PIECE_BPE).collect()
    texts = [r.text or "" for r in df.collect()]
    key = lambda r: (r[0] is None, r[0], r[1])
    want = [(r.doc_id, library.encode(t, add_bos=True, add_eos=True)) for r, t in zip(df.collect(), texts)]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=key) == sorted(want, key=key)
    assert all(r.decoded == library.decode(r.ids) for r in rows)
    packed = pieces.roundtrip_digests(pieces.encode_and_decode(df, registry.PIECE_BPE, packed=True)).collect()
    digests = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, x in want]
    assert sorted(map(tuple, packed), key=repr) == sorted(digests, key=repr)


def test_pieces_of_an_empty_table(spark):
    assert pieces.encode_and_decode(spark.createDataFrame([], SCHEMA), registry.PIECE_BPE).collect() == []


def test_pieces_equal_library_for_mixtures(library):
    rng = random.Random(3)
    enc, dec = pieces.PieceEncoder(registry.PIECE_BPE), pieces.PieceDecoder(registry.PIECE_BPE)
    normal = enc.model.pieces[259:]
    signs = ["abcdefgh ", "ab", " \n\t", "einrst ", "▁ a", "0123456789.,- ", "жзий中文字日本語한국어 ", "-=*#/ "]
    texts = []
    for _ in range(3000):
        kind = rng.random()
        if kind < 0.4:
            some = rng.choice(signs)
            texts.append("".join(rng.choice(some) for _ in range(rng.randrange(400))))
        elif kind < 0.8:
            texts.append("".join(rng.choice(normal) for _ in range(rng.randrange(60))).replace("▁", rng.choice([" ", ""])))
        else:
            texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1400), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x1F000, 0x1FFFF)])) for _ in range(rng.randrange(60))))
    flat, sizes = enc.encode(texts)
    for t, got in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert got.tolist() == library.encode(t, add_bos=True, add_eos=True), t
        assert dec.decode(got.tolist()) == library.decode(got.tolist())
    for _ in range(2000):  # ids in any order, with broken bytes
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), rng.choice([0, 1, 2, 28705])]) for _ in range(rng.randrange(12))]
        assert dec.decode(ids) == library.decode(ids)


def test_pieces_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    enc = pieces.PieceEncoder(registry.PIECE_BPE)
    for k in range(20):
        text = " ".join(f"word{k}x{j}" for j in range(30))
        assert enc.encode([text])[0].tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert enc.count < 200


# -- 12 ------------------------------------------------------------------------


def _plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    total = sum(d for d, _ in last)
    inertia = [sum(d for d, c in last if c == j) for j in range(len(cents))]
    return sorted(((i, c, d, inertia[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, last)), key=repr)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [rng.normal(size=64).astype("f4").tolist() for _ in range(150)]
    rows = [(k, x) for k, x in enumerate(v)] + [(3, v[3]), (4, v[9]), (None, v[0]), (200, None), (201, [1.0] * 63), (202, [None, *v[0][1:]]), (203, [float("nan")] * 64), (204, [float("inf"), *v[1][1:]]), (205, [0.0] * 64), (206, [0.0] * 64)]
    rows += [(300 + k, v[7]) for k in range(100)]  # one very common vector
    df = spark.createDataFrame([(i, x, 1, "c", 0) for i, x in rows], "vec_id long, embedding array<float>, cluster int, id string, x long").repartition(5)
    found = clusters.with_inertia(*clusters.cluster(df))
    assert sorted(map(tuple, found.collect()), key=repr) == _plain_clusters(rows)


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(k, [float(k)] * 64) for k in range(5)] + [(9, [4.0] * 64)]
    found = clusters.with_inertia(*clusters.cluster(spark.createDataFrame(few, schema)))
    assert sorted(map(tuple, found.collect()), key=repr) == _plain_clusters(few)
    none = clusters.with_inertia(*clusters.cluster(spark.createDataFrame([(1, None)], schema)))
    assert none.collect() == [] and none.columns == found.columns
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema))


def test_bounds_hold_and_spare_centroids():
    rng = np.random.default_rng(2)
    middle = rng.integers(-500, 500, (16, 64))
    x = (middle[rng.integers(0, 16, 3000)] + rng.integers(-6, 7, (3000, 64))).astype(np.int64)
    cents = (middle + rng.integers(-3, 4, (16, 64))).astype(np.int64)
    for points in (middle, middle[[0, 0, 1]], middle[:1]):
        s = clusters.Simplex.of(points.astype(np.int64))
        chosen, best, computed = s.nearest(x, s.project(s.distances(x)), cents)
        every = ((x[:, None] - cents[None]) ** 2).sum(-1)
        assert (chosen == every.argmin(1)).all() and (best == every.min(1)).all()
        if len(points) == 16:
            assert computed < 1.5 * len(x)
    # equal distances go to the smaller number
    two = np.array([[2] * 64, [0] * 64, [2] * 64], np.int64)
    s = clusters.Simplex.of(two)
    ones = np.ones((4, 64), np.int64)
    assert s.nearest(ones, s.project(s.distances(ones)), two)[0].tolist() == [0] * 4


# -- 13 ------------------------------------------------------------------------


def _plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in out.items())


def _listed(found):
    s, n, q = (x.tolist() for x in found)
    return list(zip(s, q, n))


def test_runs_equal_brute_force():
    rng = random.Random(6)
    texts = []
    for _ in range(3000):
        a, w = rng.choice([1, 2, 2, 3, 4, 8]), []
        for _ in range(rng.randrange(0, 6)):
            u = [rng.randrange(a) for _ in range(rng.randrange(1, 14))]
            if rng.random() < 0.5:
                u = (u * rng.randrange(1, 6) + [rng.randrange(a)])[: rng.randrange(1, 60)]
            w += u * rng.choice([1, 1, 4, 5, 6, 9]) + u[: rng.randrange(len(u) + 1)]
        texts.append([b"%d" % x for x in w])
    for t, found in zip(texts, periods.runs_of(texts)):
        assert _listed(found) == _plain_runs(t), t


def test_runs_of_long_texts():
    words = [b"a", b"b", b"c"] * 40_000
    assert _listed(periods.runs_of([words])[0]) == [(0, 3, 120_000)]
    assert _listed(periods.runs_of([[b"x"] * 50_000, words[:9]])[0]) == [(0, 1, 50_000)]
    every = [b"%d" % k for k in range(50_000)]
    found = periods.runs_of([every * 4, every])
    assert _listed(found[0]) == [(0, 50_000, 200_000)] and _listed(found[1]) == []


def test_range_successor():
    rng = np.random.default_rng(1)
    places = rng.permutation(500)[:300]
    order = periods.PlaceOrder(places)
    low = rng.integers(0, 299, 400)
    high = low + rng.integers(1, 40, 400).clip(max=300 - low)
    least = rng.integers(0, 520, 400)
    want = [min((p for p in places[a:z] if p >= x), default=-1) for a, z, x in zip(low, high, least)]
    assert order.successor(low, high, least).tolist() == want


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_run_digests(request, name):
    df = request.getfixturevalue(name)
    want = []
    for r in df.collect():
        words = periods.planted((r.text or "").encode().split(), "" if r.doc_id is None else str(r.doc_id))
        runs = _plain_runs(words)
        best = max(runs, key=lambda x: (x[2] / x[1], -x[0], -x[1]), default=None)
        gone = {i for s, q, n in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        facts = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want.append((r.doc_id, len(runs), *facts, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = periods.run_digests(periods.collapse_runs(df, repeat_some=True)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(x[1] for x in want)


def test_runs_of_an_empty_table(spark):
    assert periods.run_digests(periods.collapse_runs(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("name", ["op12_clusters", "op13_runs"])
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, sf).select(*found.columns)
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
