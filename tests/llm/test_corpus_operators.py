"""Corpus operators against brute force, on real rows and on rows made to break them."""

import hashlib
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quiverlake.llm import bpe, byte_tokens, fmindex, licenses, merkle, near_copies, packing, quality, rangecoder, registry, sharding, simhash, substrings, token_files, vectors
from quiverlake.llm.components import connected_components
from quiverlake.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k array<int>, score string, n_words string"


def _odd_texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "délta", "漢字", "x" * 90, "<|endoftext|>", "don't", "12"]
    prose = " ".join(rng.choice(words[:5]) + str(rng.randint(0, 60)) for _ in range(400))
    passage = " ".join(f"shared{k}" for k in range(60))
    return [
        None, "", " \t\n ", "one", "one two three four", prose, prose, prose.replace("alpha", "omega", 2), "\n\n\n", "a\n\nb\n\n\nc", "😀é\x85\xa0\x1c",
        "x" * 5000, "go " * 300, prose + " " + passage, passage + " tail", "Head. " + passage, "İSTANBUL Σas ΣΑΣ ﬁ½",
        " ".join(rng.choice(words) for _ in range(9000)), "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3. Etc.",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * 3 - 6, t, "en", "s", 1, "i", [k], "own", "w") for k, t in enumerate(_odd_texts())]
    rows += [rows[5], rows[0], (None, "null id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def _components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# -- 1 -------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_bpe_equals_library(request, name):
    df = request.getfixturevalue(name)
    t = Tokenizer.from_file(registry.WORD_BPE)
    for r in bpe.encode_and_decode(df.select("doc_id", "text"), registry.WORD_BPE).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_for_every_code_point():
    e, t = bpe.Encoder(registry.WORD_BPE), Tokenizer.from_file(registry.WORD_BPE)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 200):
        text = " ".join(f"{c} x{c}y{c}{c}7" for c in points[k : k + 200])
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids, hex(ord(points[k]))


def test_bpe_equals_library_for_odd_mixtures():
    e, t, rng = bpe.Encoder(registry.WORD_BPE), Tokenizer.from_file(registry.WORD_BPE), random.Random(8)
    odd = "\u0558\u1c89\ua7cb\U00010940\U0003e49baA1'sÉé\u0301\u0345ΣςİŉǅﬁßẞⅫ½ \n\x85\u3000漢<|endoftext|>"
    for _ in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 25)))
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_bpe_equals_library_for_marks_in_any_order():
    """Marks that tables of different age know, in pairs and triples behind letters of all kinds."""
    rng = random.Random(17)
    t, enc = Tokenizer.from_file(registry.WORD_BPE), bpe.Encoder(registry.WORD_BPE)
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in signs if unicodedata.category(c)[0] == "M" or unicodedata.combining(c)]
    late = [chr(c) for c in (0x7FD, 0x8D3, 0x89D, 0x345, 0x301, 0x323, 0x1AC1, 0x1DFA, 0x10EFD, 0x11F41, 0x1E4EC, 0x10D69)]
    bases = [*"aeiouAEIOU ΑΣσς가각漢", *(chr(c) for c in (*range(0xC0, 0x250), *range(0x1100, 0x1200), *range(0xF900, 0xFA40)))]
    texts = ["a\u07fd\u0301", "\u08d3\u0301", "a\u0345\u07fd"]
    texts += ["".join(rng.choice(rng.choice([marks, late, bases])) for _ in range(rng.randrange(1, 7))) for _ in range(500_000)]
    for k in range(0, len(texts), 20_000):
        part = texts[k : k + 20_000]
        for text, want in zip(part, t.encode_batch(part, add_special_tokens=False)):
            assert enc.encode(text) == want.ids, ascii(text)


def test_bpe_and_packing_of_empty_tables(empty):
    assert bpe.roundtrip_digests(bpe.encode_and_decode(empty, registry.WORD_BPE)).count() == 0
    assert packing.piece_digests(packing.pack(empty, registry.BYTE_BPE)).count() == 0


def test_bpe_streams_with_bounded_memory():
    m = bpe.MergeList(registry.WORD_BPE)
    rng = random.Random(1)
    for alphabet in ("a", "ab", "thein", "aàb漢"):
        raw = "".join(rng.choice(alphabet) for _ in range(4000)).encode()
        symbols = [m.start[b] for b in raw]
        assert list(m.stream(symbols)) == m.merge(symbols)
    assert m.lookahead < 5000


def test_decoder_state_machine():
    path = registry.BYTE_BPE
    t, d = Tokenizer.from_file(path), bpe.Decoder(path, spaced=False)
    d.STEP = 1  # characters are split over steps
    for text in ("héllo 漢字 😀 end", "", "tab\t\n"):
        assert d.decode(t.encode(text).ids) == text


# -- 2 -------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.score_held_out(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.99
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.999


def test_quality_fit_is_the_least_loss():
    """Newton's weights against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(quality.NAMES)))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=300) > 0).astype(int)
    found = quality.fit_ranking(x, y, ridge=0.01, pairs=4000, seed=5)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    pick = np.random.default_rng(5)
    good, bad = z[y == 1], z[y == 0]
    gap = good[pick.integers(len(good), size=4000)] - bad[pick.integers(len(bad), size=4000)]
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        w -= 0.2 * (-(gap / (1 + np.exp(gap @ w))[:, None]).mean(0) + 0.01 * w)
    assert np.abs(w - np.array(found.weights)).max() < 1e-3
    u = z @ w
    assert abs((u < found.threshold).mean() - (y == 0).mean()) < 0.01


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k * 3 - 6, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_held_out(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score_held_out(empty, labels).count() == 0
    none = quality.score_held_out(odd, labels.limit(0)).collect()
    assert {round(r.score, 9) for r in none} == {quality.CUT}
    kept = quality.score(odd, quality.learn(odd, labels), "score")
    assert kept.columns == odd.columns


# -- 3 -------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_merkle_equals_brute_force(request, name):
    df = request.getfixturevalue(name).select("doc_id", "text", "lang")
    rows = sorted(_pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = merkle.fingerprint(t), merkle.fingerprint(e), merkle.fingerprint(nxt)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(merkle.likeness(a, b), 9), round(merkle.likeness(a, c), 9)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in merkle.compare_with_successor(df).collect())
    assert got == want


def test_merkle_locates_edits(empty):
    a = merkle.fingerprint("one two.\nthree four. five\n\nsix")
    b = merkle.fingerprint("one two.\nthree FOUR. five\n\nsix")
    assert merkle.edits(a, a) == [] and merkle.likeness(a, a) == 1
    assert {(s, p) for s, p, _ in merkle.edits(a, b)} == {(0, 1)}
    assert 0 < merkle.likeness(a, b) < 1
    # only nodes are compared on the way down: what lies below an equal node isn't looked at
    head, sections = merkle._split(a)
    blind = a[: merkle._ROOT] + f"{head}:" + sections[0] + ":" + sections[1][: merkle._NODE] + ".damaged"
    assert merkle.edits(blind.replace(a[0], "0" if a[0] != "0" else "1", 1), b) == merkle.edits(a, b)
    long = "字" * 400 + " d " + "x" * 400
    assert merkle.likeness(merkle.fingerprint(long), merkle.fingerprint(long + "!")) > 0.9
    assert merkle.fingerprint("a\nb") != merkle.fingerprint("a\n\nb")
    assert merkle.compare_with_successor(empty).count() == 0


# -- 4 -------------------------------------------------------------------------


def _wrapped(text, mark=" * ", width=60):
    lines, now = [], ""
    for w in text.split(" "):
        if len(now) + len(w) > width:
            lines.append(now)
            now = ""
        now = f"{now} {w}".strip()
    return "\n".join(mark + x for x in [*lines, now])


def test_license_rules(spark, odd, empty):
    for rule, licence, text in licenses.NOTICES:
        for form in (text, _wrapped(text), _wrapped(text, "# "), "// file\n/*\n" + _wrapped(text) + "\n */\ncode();", "Before.\n\n" + text.replace(". ", ".\n\n") + "\n\nAfter."):
            assert [m[:2] for m in licenses.matches(licenses.identifiers(form))] == [(rule, licence)], (rule, form)
    bsd = next(t for r, _, t in licenses.NOTICES if r == "bsd3-text")
    numbered = bsd.replace("met: ", "met:\n\n1. ").replace("disclaimer. R", "disclaimer.\n2. R").replace("distribution. N", "distribution.\n\n3. N")
    assert [m[1] for m in licenses.matches(licenses.identifiers(numbered))] == ["BSD-3-Clause"]
    for rule, licence, names in licenses.NAMES:
        for name in names:
            assert [m[:2] for m in licenses.matches(licenses.identifiers(f"some words\nReleased under {name}.\nmore words"))] == [(rule, licence)]
    for tag in ("MIT", "Apache-2.0", "GPL-2.0-or-later"):
        assert [m[1] for m in licenses.matches(licenses.identifiers(f"#!/bin/sh\n# SPDX-License-Identifier: {tag}\necho"))] == [tag]
    parts = next(t for r, _, t in licenses.NOTICES if r == "mit-text").split(". ")
    assert licenses.matches(licenses.identifiers(". ".join([parts[1], parts[0]]))) == []
    spelled = defaultdict(list)
    for n, k in licenses.KNOWN.items():
        spelled[k].append(n)
    assert all(any(all(re.search(licenses.HINTS, n) for n in spelled[i]) for i in ids) for _, _, ids in licenses.RULES)
    found = Counter(r.licence for r in licenses.scan(odd).collect())
    assert found == {"MIT": 1, "CC-BY-NC-4.0": 1, "GPL-3.0-only": 1}
    assert licenses.scan(empty).count() == 0


def _found(text):
    return [m[:2] for m in licenses.matches(licenses.identifiers(text))]


def test_license_sentences_may_be_broken_anywhere():
    """A line end, or two spaces, or a comment mark in place of any space."""
    for rule, licence, text in licenses.NOTICES:
        for k in [i for i, c in enumerate(text) if c == " "]:
            for gap in ("\n", "  ", "\n # "):
                assert _found(f"{text[:k]}{gap}{text[k + 1 :]}") == [(rule, licence)], (rule, k)
    for rule, licence, names in licenses.NAMES:
        for text in (f"Distributed under {n}." for n in names):
            for k in [i for i, c in enumerate(text) if c == " "]:
                for gap in ("\n", "  ", "\r\n"):
                    assert (rule, licence) in _found(f"Words before.\n\n{text[:k]}{gap}{text[k + 1 :]}\n\nWords after."), (rule, k)


def test_license_headings_expressions_and_trailing_clauses():
    assert _found("Project\n\nMIT License\n\nCopyright (c) 2020") == [("mit-heading", "MIT")]
    assert _found("code (c)\n(MIT License)\n") == [("mit-heading", "MIT")]
    assert _found("This project is licensed under the MIT license - see the LICENSE file") == [("mit-line", "MIT")]
    assert _found("// SPDX-License-Identifier: MIT OR Apache-2.0\n") == [("spdx-mit or apache-2.0", "MIT OR Apache-2.0")]
    assert _found("# SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause)\n") == [("spdx-gpl-2.0-only and bsd-3-clause", "GPL-2.0-only AND BSD-3-Clause")]
    assert _found("The license of this text is a matter of taste.") == []


# -- 5 -------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base * 3, base + rng.normal(size=base.shape) * 0.1, base[:1].repeat(5, 0), rng.normal(size=(60, 16))]).astype(np.float32)
    rows = [(k * 2, v.tolist(), "own") for k, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8]
    rows += [(1000 + k, v, None) for k, v in enumerate(odd)] + [(None, x[0].tolist(), "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, c string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, row=40).collect()}
    y = np.concatenate([x, x[:1]]).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    g = y @ y.T >= 0.95
    ids = [k * 2 for k in range(len(x))] + [None]
    comp = _components(len(y), zip(*np.nonzero(np.triu(g, 1))))
    least = defaultdict(lambda: 10**9)
    for k, c in enumerate(comp):
        if ids[k] is not None:
            least[c] = min(least[c], ids[k])
    want = {(ids[k], int(g[k].sum() - 1), least[comp[k]], ids[k] == least[comp[k]]) for k in range(len(y))}
    want |= {(1000 + k, 0, 1000 + k, True) for k in range(len(odd))}
    assert got == want
    assert vectors.near_vectors(df.limit(0)).count() == 0
    wide = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(wide).collect()} == got
    assert [vectors.tile_rows(n, t) for n, t in ((0, 211), (400, 211), (10256, 211), (51282, 51), (10**6, 6))] == [1, 1, 20, 10, 163]


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(5)
    u = vectors.unit(rng.normal(size=(200, 64)))
    q, s, e = vectors.quantise(u)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(near - u @ u.T) <= e[:, None] * (1 + e[None, :]) + e[None, :] + 1e-12).all()


# -- 6 -------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_shards(request, name):
    df = request.getfixturevalue(name)
    rows = sharding.shard_by_bytes(df).collect()
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in _pairs(df))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if name == "docs":
        assert all(len(h) == 1 for h in homes.values())
        assert max(sizes.values()) - min(sizes.values()) < 0.2 * sum(sizes.values()) / 16


def test_shards_equal_plain_tree(spark, docs):
    """Loads of the leaves against a plain k-d tree that sorts the units at each node and cuts at the weighted median."""
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    units = sharding._places(
        rows.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce(F.octet_length("text"), F.lit(0))).alias("h"))
        .groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("unit_rows"), F.min("doc_id").alias("least_id"))
    ).collect()
    total = sum(u.bytes for u in units)
    heavy = sorted((u.bytes for u in units if u.bytes > sharding.HEAVY * total / 16), reverse=True)
    loads = [0] * 16
    for b in heavy:
        loads[loads.index(min(loads))] += b
    light = [u for u in units if u.bytes <= sharding.HEAVY * total / 16]
    level = total / 16
    for _ in range(40):  # what the rest is levelled to
        full = [x for x in loads if x > level]
        level = (total - sum(full)) / (16 - len(full))
    wants = [max(0.0, level - x) for x in loads]

    def leaves(part, a, b):
        if a == b:
            return [sum(u.bytes for u in part)]
        d = max(sharding.DIMS, key=lambda d: (max(u[d] for u in part) - min(u[d] for u in part), d))
        part = sorted(part, key=lambda u: u[d])
        mid = (a + b) // 2
        want = sum(wants[a : mid + 1]) / sum(wants[a : b + 1]) * sum(u.bytes for u in part)
        run, k = 0, 0
        while k < len(part) and run + part[k].bytes / 2 < want:
            run += part[k].bytes
            k += 1
        return leaves(part[:k], a, mid) + leaves(part[k:], mid + 1, b)

    plain = [x + y for x, y in zip(loads, leaves(light, 0, 15))]
    out = sharding.shard_by_bytes(rows).collect()
    got = Counter()
    for r in out:
        got[r.shard] += r.size
    assert len({r.shard for r in out if r.doc_id >= 10**6}) == 1  # null and empty are equal texts
    assert max(abs(got[k] - plain[k]) for k in range(16)) <= 2 * max(u.bytes for u in light)


def test_shards_of_hot_and_empty_tables(spark, empty):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = {r.shard: r["sum(size)"] for r in sharding.shard_by_bytes(hot).groupBy("shard").sum("size").collect()}
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 16 and max(rest) < 1.1 * min(rest)
    assert sharding.shard_by_bytes(empty).count() == 0
    assert sharding.shard_by_bytes(hot, target_bytes=20_000).select("shard").distinct().count() > 4


# -- 7 -------------------------------------------------------------------------


def _simhash(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if x]
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_simhash_equals_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = _pairs(df)
    f = [_simhash(t) for _, t in rows]
    comp = _components(len(f), [(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if (f[a] ^ f[b]).bit_count() <= 4])
    least = defaultdict(lambda: 10**9)
    for k, c in enumerate(comp):
        if rows[k][0] is not None:
            least[c] = min(least[c], rows[k][0])
    want = Counter((rows[k][0], f"{f[k]:016x}", least[comp[k]] if comp[k] in least else None) for k in range(len(rows)))
    got = Counter((r.doc_id, r.h, r.component_id) for r in simhash.components(df).select("doc_id", simhash.as_hex().alias("h"), "component_id").collect())
    assert got == want


def test_gray_index_joins_like_all_pairs(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 300))
        c = np.repeat(rng.integers(-(2**63), 2**63 - 1, size=max(1, n // 6)), 6)
        for _ in range(int(rng.integers(0, 5))):
            c = c ^ (np.int64(1) << rng.integers(0, 63, size=len(c)))
        c = np.unique(c)
        near = np.bitwise_count(c.view(np.uint64)[:, None] ^ c.view(np.uint64)[None, :]) <= 4
        at = {x: k for k, x in enumerate(c.tolist())}
        assert _components(len(c), [(at[a], at[b]) for a, b in simhash.join_tiles(c, None)]) == _components(len(c), zip(*np.nonzero(np.triu(near, 1))))
    # hot mask values are tiled; the groups stay the same
    fps = spark.createDataFrame([(int(x),) for x in c] + [(k,) for k in range(200)], "fp long").distinct()
    one = {(r.node, r.component) for r in connected_components(simhash.link_fingerprints(fps)).collect()}
    assert one == {(r.node, r.component) for r in connected_components(simhash.link_fingerprints(fps, tile=16)).collect()}


def test_simhash_keeps_one(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = _pairs(odd)
    f = [_simhash(t) for _, t in rows]
    comp = _components(len(f), [(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if (f[a] ^ f[b]).bit_count() <= 4])
    ids = defaultdict(list)
    for k, c in enumerate(comp):
        ids[c].append((rows[k][0] is None, rows[k][0] or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min(v) for v in ids.values())
    twice = odd.where("doc_id = 9").union(odd.where("doc_id = 9"))
    assert simhash.keep_one(twice).count() == 1
    assert simhash.components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def _near_copies(rows):
    """Smallest id of each row's group: all pairs of five-word shingle sets with a Jaccard similarity of 0.8."""
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()})
    like = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    return _components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if like(sets[a], sets[b])])


def _edited(seed=9):
    """Texts in chains: each is made of the one before by some changed words, so similarities are of all sizes."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((6, 40, 150, 400)))]
        for _ in range(6):
            texts.append(" ".join(w))
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 5000)}"
    return texts


@pytest.mark.parametrize("name", ["odd", "docs", "edited", "hot"])
def test_near_copies_equal_brute_force(request, spark, name):
    if name == "edited":
        df = spark.createDataFrame(list(enumerate(_edited())), "doc_id long, text string")
    elif name == "hot":  # one text with other words changed each time
        base, rng = [f"b{k}" for k in range(200)], random.Random(2)
        texts = [" ".join(f"x{k}.{j}" if j in at else w for j, w in enumerate(base)) for k in range(120) for at in [set(rng.sample(range(200), rng.randint(1, 7)))]]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        df = request.getfixturevalue(name)
    rows = sorted(_pairs(df), key=lambda r: (r[0] is None, r[0] or 0))
    comp = _near_copies(rows)
    want = Counter(rows[c] for c in set(comp))  # a group's first row has its smallest id
    kept = corpus_pipeline.keep_one_of_copies(spark, df, None)
    assert kept.columns == df.columns
    assert Counter(_pairs(kept)) == want
    if name == "hot":  # clusters of many rows
        assert Counter(_pairs(near_copies.keep_one(df, row_shingles=600))) == want


def test_common_counts():
    rng = np.random.default_rng(4)
    for few in (12, 2):
        sets = [np.unique(rng.integers(0, 300, size=rng.integers(0, 200))) for _ in range(60)]
        near_copies._FEW, kept = few, near_copies._FEW
        got = np.triu(near_copies.common_counts(sets), 1)
        near_copies._FEW = kept
        assert (got == np.triu([[len(np.intersect1d(a, b)) for b in sets] for a in sets], 1)).all()


# -- 8, 9 ----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_packing_covers_every_id_once(request, name):
    df = request.getfixturevalue(name)
    t = Tokenizer.from_file(registry.BYTE_BPE)
    ids = {(i, x): t.encode(x, add_special_tokens=False).ids + [1] for i, x in _pairs(df)}
    cover, spans = Counter(), defaultdict(list)
    for r in packing.pack(df, registry.BYTE_BPE).collect():
        part = np.frombuffer(r.tokens, "<u4").tolist()
        spans[r.sequence_id].append((r.offset, len(part)))
        fits = [k for k, v in ids.items() if k[0] == r.doc_id and v[r.start : r.start + len(part)] == part and len(v) == r.doc_tokens]
        assert fits
        cover[r.doc_id] += len(part)
    want = Counter()
    for i, x in _pairs(df):
        want[i] += len(ids[i, x])
    assert cover == want
    for v in spans.values():
        v.sort()
        assert v[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= packing.WINDOW


def test_differencing_is_near_equal():
    rng = random.Random(2)
    sizes = [rng.randint(1, 512) for _ in range(900)]
    loads = [sum(sizes[k] for k in w) for w in packing.deal(sizes, 2048)]
    assert sorted(k for w in packing.deal(sizes, 2048) for k in w) == list(range(900))
    assert max(loads) <= 2048 and max(loads) - min(loads) < 40
    assert packing.deal([], 2048) == []


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_token_files_round_trip(request, spark, tmp_path, name):
    df = request.getfixturevalue(name)
    t = Tokenizer.from_file(registry.BYTE_BPE)
    out = f"{tmp_path}/tokens"
    token_files.write_tokens(df, out, registry.BYTE_BPE)
    got = sorted((r.start, r.doc_id, r.tokens) for r in token_files.read_tokens(spark, out).collect())
    want, at = [], 0
    for i, x in sorted(_pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes()
        want.append((at, i, bytearray(ids)))
        at += len(ids) // 4
    assert got == want


def test_range_coder_blocks():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 65536, size=n) for n in (0, 1, 3, 700)] + [np.full(900, 65535), rng.integers(0, 3, size=1500), np.tile(rng.integers(0, 50257, size=30), 40)]
    coded = rangecoder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode_blocks(coded, [len(b) for b in blocks])))
    assert rangecoder.encode_blocks([blocks[3]])[0] == coded[3]  # a block depends on itself alone
    assert len(coded[-1]) < 500 and rangecoder.encode_blocks([]) == []
    with pytest.raises(ValueError):
        rangecoder.encode_blocks([np.array([70000])])
    wide = [rng.integers(0, 1 << 20, size=n) for n in (2, 1024, 333)]
    assert all((a == b).all() for a, b in zip(wide, rangecoder.decode_blocks(rangecoder.encode_blocks(wide, 20), [len(b) for b in wide], 20)))
    for k in range(60):  # damage changes ids, never hangs or fails
        bad = bytearray(coded[3])
        bad[int(rng.integers(0, len(bad)))] ^= 1 << int(rng.integers(0, 8))
        assert len(rangecoder.decode_blocks([bytes(bad[: len(bad) - k % 3])] if k % 3 == 0 else [bytes(bad)], [700])[0]) == 700


def test_range_coder_beats_plain_compression(docs):
    """Clearly smaller than a dictionary coder on the same blocks, which start anew like ours."""
    tokenizer = byte_tokens.byte_tokenizer(registry.BYTE_BPE)
    ids = np.concatenate([np.append(np.frombuffer(tokenizer.encode(r.text or ""), "<u4"), 2) for r in docs.orderBy("doc_id").collect()])
    blocks = [ids[k : k + rangecoder.BLOCK] for k in range(0, len(ids), rangecoder.BLOCK)]
    coded = rangecoder.encode_blocks(blocks)
    plain = sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    assert sum(map(len, coded)) < min(0.85 * plain, 1.10 * len(ids))
    for a, b in zip(blocks, rangecoder.decode_blocks(coded, list(map(len, blocks)))):
        assert (a == b).all()


def test_range_coder_cost(docs):
    """Ids coded and read take a few times what their texts take to tokenize, in 0.95 bytes an id."""
    cut = lambda x: [x[k : k + rangecoder.BLOCK] for k in range(0, len(x), rangecoder.BLOCK)]
    tokenizer = byte_tokens.byte_tokenizer(registry.BYTE_BPE)
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    at = time.process_time()
    ids = np.concatenate([np.append(np.frombuffer(tokenizer.encode(x), "<u4"), 2) for x in texts])
    plain = (time.process_time() - at) / len(ids)
    size = sum(map(len, rangecoder.encode_blocks(cut(ids)))) / len(ids)
    blocks = cut(np.tile(ids, 6)[: 1 << 20])
    at = time.process_time()
    back = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks), list(map(len, blocks)))
    took = (time.process_time() - at) / (1 << 20)
    assert all((a == b).all() for a, b in zip(blocks, back))
    assert size < 0.95 and took < 4 * plain, (size, took, plain)


@pytest.mark.parametrize("bits", [16, 20])
def test_range_coder_lanes(bits):
    """Lanes of unlike length, frequent and rare ids, more ids than have a frequency, one id alone."""
    rng = np.random.default_rng(4)
    top = (1 << bits) - 1
    sizes = [1, 2, 511, 512, 1023, 1024, 1025, 7000, 150_000]
    blocks = [np.minimum(rng.zipf(1.2, size=n) - 1, top) for n in sizes] + [rng.integers(0, top + 1, size=70_000), np.full(3000, top), np.zeros(2000, int), np.tile(rng.integers(0, top, size=5000), 9)]
    coded = rangecoder.encode_blocks(blocks, bits)
    for a, b in zip(blocks, rangecoder.decode_blocks(coded, list(map(len, blocks)), bits)):
        assert (a == b).all()
    assert len(coded[-3]) < 100 and len(coded[-2]) < 100 and rangecoder.encode_blocks(blocks[3:4], bits) == coded[3:4]
    bad = bytearray(coded[8])
    for k in rng.integers(0, len(bad), size=40).tolist():  # lengths of lanes among them
        bad[k] ^= 1 << k % 8
    assert len(rangecoder.decode_blocks([bytes(bad)], [sizes[8]], bits)[0]) == sizes[8]


def test_token_rows_are_cut_evenly(spark, tmp_path):
    """A document of more ids than a block has is one row of even blocks; others share rows up to that size."""
    text = "".join(map(str, range(200_000)))
    df = spark.createDataFrame([(1, "a b"), (2, text), (3, None)], "doc_id long, text string")
    t, out = Tokenizer.from_file(registry.BYTE_BPE), f"{tmp_path}/t"
    token_files.write_tokens(df, out, registry.BYTE_BPE)
    for r in spark.read.parquet(out).collect():
        assert sum(r.lengths) == r.ids and len(r.blocks) == len(r.sums) == -(-r.ids // rangecoder.BLOCK)
    got = {r.doc_id: (r.start, bytes(r.tokens)) for r in token_files.read_tokens(spark, out).collect()}
    at = 0
    for i, x in ((1, "a b"), (2, text), (3, "")):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert got[i] == (at, ids)
        at += len(ids) // 4


def test_damaged_block_raises(spark, docs, tmp_path):
    out, bad = f"{tmp_path}/t", f"{tmp_path}/bad"
    token_files.write_tokens(docs.limit(5), out, registry.BYTE_BPE)
    spark.read.parquet(out).withColumn("sums", F.transform("sums", lambda s: s + 1)).write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_tokens(spark, bad).collect()


def test_byte_tokenizer_equals_library():
    rng = random.Random(5)
    signs = "abc thein'sS  \n\t\x1c\x85\xa0漢かな한При1234½²!?-_#<|endoftext|>😀é"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a<|endoftext|>b", "x" * 9000, " " * 5000 + "a"]
    e, t = byte_tokens.ByteTokenizer(registry.BYTE_BPE), Tokenizer.from_file(registry.BYTE_BPE)
    assert all(list(e.encode(x)) == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_byte_tokenizer_blanks():
    """Every sign of white space alone, doubled, at the ends and beside words, and signs that Python alone takes for one."""
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff", ""]
    e, t = byte_tokens.ByteTokenizer(registry.BYTE_BPE), Tokenizer.from_file(registry.BYTE_BPE)
    for a in blanks:
        for b in blanks:
            for x in (f"{a}it's{b}12{a}{b}é-x{b}", f"a{a}'ll{b}", f"{b}q {a}7"):
                assert list(e.encode(x)) == t.encode(x, add_special_tokens=False).ids, repr(x)


# -- 10 ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_substrings_equal_brute_force(request, monkeypatch, name):
    df = request.getfixturevalue(name)
    if name == "odd":
        monkeypatch.setattr(substrings, "HOT", 3)  # some minimisers are spread
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in _pairs(df)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    out = substrings.removal_digests(substrings.remove_repeats(df.drop("n_words")))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == want


def test_substrings_hot_windows_bring_no_words(spark, monkeypatch):
    """A passage at whose edges each text has its own words: equal windows are counted, not gathered."""
    monkeypatch.setattr(substrings, "HOT", 20)
    seen = []
    cut = substrings._segments
    monkeypatch.setattr(substrings, "_segments", lambda *a: seen.append(cut(*a)) or seen[-1].cache())
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"a{i}.{k}" for k in range(40)) + f" {passage} " + " ".join(f"z{i}.{k}" for k in range(40)) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = substrings.remove_repeats(df).collect()
    assert [r.n_removed for r in out] == [60] * 100 and all("p1 " not in r.text for r in out)
    gathered = Counter(tuple(r.words.split()[k : k + 35]) for r in seen[0].collect() if r.words is not None for k in range(len(r.words.split()) - 34))
    assert max(gathered.values(), default=0) <= 20


def test_settings_and_odd_columns(spark, odd, sf):
    before = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    clash = odd.withColumns({"k": F.lit("mine"), "k2": F.lit(2), "spans": F.lit("s"), "_k": F.lit(1.5), "fp": F.lit("f"), "s": F.lit("z"), "n": F.lit("n")})
    out = substrings.remove_repeats(clash)
    assert out.columns == [*clash.columns, "n_removed"]
    assert all((r.k, r.k2, r.spans, r._k) == ("mine", 2, "s", 1.5) for r in out.collect())
    for _, stage in corpus_pipeline.STAGES[:2]:
        done = stage(spark, clash, sf)
        assert done.columns == clash.columns and all(r.k == "mine" for r in done.collect())
    assert (dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())) == before


def test_text_ids(spark, odd, tmp_path):
    df = odd.withColumn("doc_id", F.concat(F.lit("d"), F.lpad((F.col("doc_id") + 6).cast("string"), 3, "0")))
    t = Tokenizer.from_file(registry.BYTE_BPE)
    rows = sorted(_pairs(df), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    token_files.write_tokens(df, f"{tmp_path}/t", registry.BYTE_BPE)
    got = sorted((r.start, r.doc_id, len(r.tokens) // 4) for r in token_files.read_tokens(spark, f"{tmp_path}/t").collect())
    assert [(i, n) for _, i, n in got] == [(i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in rows]
    near = Counter((r.doc_id, round(r.near_next, 9)) for r in merkle.compare_with_successor(df).collect())
    want = Counter((i, round(merkle.likeness(merkle.fingerprint(x), merkle.fingerprint(rows[(k + 1) % len(rows)][1])), 9)) for k, (i, x) in enumerate(rows))
    assert near == want


def test_substrings_keep_columns(odd, empty):
    out = substrings.remove_repeats(odd, counts=("__a", "__b"))
    assert out.columns == [*odd.columns, "__a", "__b"] and out.count() == odd.count()
    assert substrings.remove_repeats(empty).count() == 0


def test_fm_index_counts_every_stretch():
    rng = np.random.default_rng(8)
    text = rng.integers(2, 6, size=300)
    index = fmindex.FMIndex(text, np.ones(300, np.int64))
    lengths = index.matching_lengths(np.arange(300), np.minimum(12, np.arange(300) + 1))
    for end in range(300):
        best = 0
        for n in range(1, min(12, end + 1) + 1):
            part = text[end - n + 1 : end + 1]
            if sum((text[k : k + n] == part).all() for k in range(300 - n + 1)) >= 2:
                best = n
        assert lengths[end] == best


# -- pipeline ------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf)
    assert good.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = docs.join(labels, "doc_id").select("doc_id", "quality").collect()
    kept_ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum((r.doc_id in kept_ids) == bool(r.quality) for r in judged) >= 0.95 * len(judged)
    rows = sorted(_pairs(good))
    rows = [rows[k] for k in sorted(set(_near_copies(rows)))]
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t), t) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w, _ in words for k in range(len(w) - 34))
    t = Tokenizer.from_file(registry.BYTE_BPE)
    want = {}
    for i, w, text in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        text = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text
        want[i] = len(t.encode(text, add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id: r.n for r in got} == want and all(r.n == r.d for r in got)


def test_pipeline_stages_take_odd_tables(spark, odd, empty, sf):
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = materialize(stage(spark, df, sf), name)
            assert df.columns == odd.columns, name


def test_license_sql_agrees(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = ["doc_id", "licence", "rule", "first_word", "end_word"]
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({licenses.oracle_sql()})").fetchall()
    assert sorted(tuple(r) for r in registry.op4_licenses(spark, sf).select(*cols).collect()) == sorted(want)
