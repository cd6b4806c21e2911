"""Near copies by exact similarity: sets of word shingles whose Jaccard similarity is 0.8 or more are linked.

This is the general form of the SimHash operator, for similarities that fingerprints of 64 bits can't decide:
at a Jaccard similarity of 0.8 about ten bits differ, with a deviation of three, so that a bound which loses
none would let unrelated texts meet.  The Gray-order index proposes the near pairs; sets decide; and meeting
places find the pairs that the fingerprints miss.

1.  Each text becomes the set of hashes of its five-word shingles; texts of one set are one from here on.
    Pairs that the index of :mod:`quiverlake.llm.simhash` proposes are checked by their sets and linked.
2.  Of ``n`` hashes the least ``2 (n div 5) + 1`` are looked at; two similar sets have ``ceil(0.8 n) div 5 + 1``
    of these in common or more.  They are ordered, rarest first, and all but the last ``ceil(0.8 n) div 5`` are
    meeting places; hashes of a single set can't be shared and are left out.  So a pair that is to be linked
    meets at one of them; no pair is lost, and frequent passages are seldom met at.
3.  A meeting place's sets are first compared with one of them, and links form components.  What then still
    meets across components is a cluster: sets that meeting places join, directly or not.  A cluster is dealt
    to rows of bounded size, each pair of rows is compared inside one task, by products of the incidence
    matrices of sets and shingles, and leaves it as a forest of links between components.  Two rows of one
    component have nothing to compare, so a large group of copies costs no more than its members.

Defined results: null texts count as empty; texts without words are copies of each other; fewer words than a
shingle give one shingle; groups are all that links reach; exactly one row of each group stays, the one of
the smallest id (null last), also where rows repeat; texts of any length are read whole; all columns stay,
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import keep_keys, map_rows, row_keys, text_of
from quiverlake.llm.components import connected_components
from quiverlake.llm.simhash import BITS, _Forest, link_fingerprints, majority, shingle_hashes
from quiverlake.session import discard, materialize

WORDS = 5
#: Shingles of a row of sets, more or less; they decide what a task holds and don't change results.
ROW_SHINGLES = 150_000
#: Shingles that more sets of a task share are counted by matrix products, and columns of a product.
_FEW, _COLUMNS = 12, 2048


def low_hashes(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(k, k2, id, s, n, fp, low)``: keys of the row, name of its set, size, fingerprint, least hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b["text"]]
            names = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield {"k": b["k"], "k2": b["k2"], "id": b["id"], "s": names, "n": [len(x) for x in sets], "fp": [majority(x.view(np.uint64)) for x in sets], "low": [x[: 2 * (len(x) // 5) + 1] for x in sets]}

    given = docs.select(*[c.alias(n) for n, c in row_keys(id_col, text_col).items()], F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_rows(given, rows, f"k long, k2 long, id {kind}, s long, n int, fp long, low array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(s, n, shingles)`` for the rows ``wanted (k, k2, s)``; each set once."""

    def rows(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b["text"]]
            yield {"s": b["s"], "n": [len(x) for x in sets], "shingles": sets}

    given = docs.select(*[c.alias(n) for n, c in row_keys(id_col, text_col).items()], text_of(text_col).alias("text"))
    return map_rows(given.join(wanted, ["k", "k2"]).select("s", "text"), rows, "s long, n int, shingles array<long>").dropDuplicates(["s"])


def meeting_places(low: DataFrame) -> DataFrame:
    """Rows ``(h, s, n)``: the shingles at which a set meets those that can be similar."""
    each = low.select("s", F.explode("low").alias("h"))
    # written first, so that the join has exchanges of its own whose hot parts can be split
    often = materialize(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    repeated = materialize(each.join(often, "h"), "repeated")
    discard(often)
    listed = repeated.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o")).join(low.select("s", "n"), "s")
    left = F.expr("2 * (n div 5) + 1 - ((4 * n + 4) div 5) div 5 - (2 * (n div 5) + 1 - size(o))").cast("int")
    places = listed.withColumn("left", left).where("left > 0").select("s", "n", F.explode(F.slice("o", F.lit(1), F.col("left"))).alias("o")).select("o.h", "s", "n")
    places = materialize(places, "places")
    discard(repeated)
    return places


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a similarity of 0.8 or more."""
    pairs = materialize(pairs, "pairs")
    one, two = (sets.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    links = materialize(pairs.join(one, "a").join(two, "b").where(9 * both >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "links")
    discard(pairs)
    return links


def _fits(a: str, b: str) -> F.Column:
    """Sets of these sizes can be similar."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def proposals(low: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs ``(a, b)`` of sets whose fingerprints are equal or linked in a forest of the Gray-order index."""
    first = materialize(low.groupBy("fp").agg(F.min("s").alias("rep")), "fingerprints")
    same = low.join(first, "fp").where("s <> rep").select(F.col("rep").alias("a"), F.col("s").alias("b"))
    one, two = (first.select(F.col("fp").alias(x), F.col("rep").alias(f"r{x}")) for x in "ab")
    linked = link_fingerprints(first.select("fp"), bits).join(one, "a").join(two, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return same.union(linked).distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each pair of sets shares, above the diagonal; a set holds a hash once."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0]
    often = np.diff(np.append(first, len(flat)))
    shared = np.zeros(m * m, np.int64)
    for k in np.unique(often[(often > 1) & (often <= _FEW)]).tolist():
        held = owner[first[often == k][:, None] + np.arange(k)]  # owners ascend
        for x in range(k):
            for y in range(x + 1, k):
                shared += np.bincount(held[:, x] * m + held[:, y], minlength=m * m)
    shared = shared.reshape(m, m)
    many = np.nonzero(often > _FEW)[0]
    for at in range(0, len(many), _COLUMNS):
        part = many[at : at + _COLUMNS]
        column = np.repeat(np.arange(len(part)), often[part])
        place = np.repeat(first[part] - np.concatenate([[0], np.cumsum(often[part])[:-1]]), often[part]) + np.arange(len(column))
        held = np.zeros((m, len(part)), np.float32)
        held[owner[place], column] = 1
        shared += (held @ held.T).astype(np.int64)
    return shared


def _links_between(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Forest of links between components; where there are two sides, sets of one side aren't compared."""
    size = np.array([len(x) for x in sets])
    near = np.triu(9 * common_counts(sets) >= 4 * (size[:, None] + size[None, :]), 1) & (component[:, None] != component[None, :])
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    names, at = np.unique(component, return_inverse=True)
    forest = _Forest(len(names))
    i, j = np.nonzero(near)
    forest.link(at[i], at[j])
    roots = forest.roots()
    return [(int(names[k]), int(names[roots[k]])) for k in np.nonzero(roots != np.arange(len(names)))[0]]


def _compare_clusters(members: DataFrame, sets: DataFrame, row_shingles: int) -> DataFrame:
    """Links ``(a, b)`` between components of ``members (s, n, c, cluster)``."""
    n = lambda w: F.ceil(F.col(w) / row_shingles).cast("int")
    weights = materialize(members.groupBy("cluster", "c").agg(F.sum("n").alias("w")), "weights")
    large = weights.where(F.col("w") > row_shingles).select("cluster", "c", n("w").alias("parts"))
    bins = weights.where(F.col("w") <= row_shingles).groupBy("cluster").agg(F.sum("w").alias("w")).select("cluster", n("w").alias("bins"))
    whole = F.col("parts").isNotNull()
    spot = F.when(whole, F.pmod(F.xxhash64("s"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("c"), F.col("bins")))
    dealt = members.join(large, ["cluster", "c"], "left").join(bins, "cluster", "left")
    dealt = materialize(dealt.select("s", "n", "c", "cluster", F.when(whole, F.col("c")).alias("own"), F.xxhash64("cluster", F.when(whole, F.col("c")), spot).alias("row")), "rows")
    rows = materialize(dealt.select("cluster", "own", "row").distinct(), "row_names")
    other = rows.select("cluster", F.col("own").alias("own2"), F.col("row").alias("row2"))
    pairs = rows.join(other, "cluster").where((F.col("row") <= F.col("row2")) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False)))
    sides = F.when(F.col("row") == F.col("row2"), F.array(F.struct(F.col("row"), F.lit(False).alias("side")))).otherwise(F.array(F.struct(F.col("row"), F.lit(False).alias("side")), F.struct(F.col("row2").alias("row"), F.lit(True).alias("side"))))
    sent = materialize(pairs.select(F.xxhash64("row", "row2").alias("pair"), F.explode(sides).alias("x")).select("pair", "x.row", "x.side").join(dealt.select("row", "s", "n", "c"), "row"), "sent")
    total = sent.agg(F.sum("n")).first()[0] or 0
    groups = 1 + total // row_shingles

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pair", "ascending"), ("s", "ascending")])
        pair, component, side = table["pair"].to_numpy(), table["c"].to_numpy(), table["side"].to_numpy()
        flat, ends = table["shingles"].combine_chunks(), np.concatenate([[0], np.cumsum(table["n"].to_numpy())])
        values = flat.flatten().to_numpy()
        cuts = np.concatenate([[0], np.nonzero(pair[1:] != pair[:-1])[0] + 1, [len(pair)]]).tolist()
        found = [e for a, b in zip(cuts, cuts[1:]) for e in _links_between([values[ends[k] : ends[k + 1]] for k in range(a, b)], component[a:b], side[a:b])]
        return pa.table({"a": [e[0] for e in found], "b": [e[1] for e in found]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    shipped = sent.select("pair", "side", "s", "c", F.pmod(F.xxhash64("pair"), F.lit(groups)).alias("group")).join(sets, "s")
    links = materialize(shipped.groupBy("group").applyInArrow(compare, "a long, b long"), "links")
    for t in (weights, dealt, rows, sent):
        discard(t)
    return links


def groups(places: DataFrame, sets: DataFrame, low: DataFrame, row_shingles: int = ROW_SHINGLES) -> DataFrame:
    """Rows ``(node, component)`` of the sets that have a link; ``sets`` holds each set of ``places`` once."""
    found = [_similar(proposals(low), sets)]

    def placed() -> DataFrame:
        named = connected_components(reduce(DataFrame.union, found))
        return places.join(named, places.s == named.node, "left").select("h", "s", "n", F.coalesce("component", "s").alias("c"))

    def open_places(now: DataFrame) -> DataFrame:
        # a place whose sets are all in one component has nothing left to compare
        firsts = now.groupBy("h").agg(F.min(F.struct(F.xxhash64("s").alias("x"), "s", "n", "c")).alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        return materialize(firsts.select("h", "f.s", "f.n", "f.c").toDF("h", "fs", "fn", "fc"), "firsts")

    now = materialize(placed(), "placed")
    firsts = open_places(now)
    met = now.join(firsts, "h").where((F.col("c") != F.col("fc")) & _fits("n", "fn"))
    found.append(_similar(met.select(F.least("s", "fs").alias("a"), F.greatest("s", "fs").alias("b")).distinct(), sets))
    for t in (now, firsts):
        discard(t)
    now = materialize(placed(), "placed")
    firsts = open_places(now)
    live = materialize(now.join(firsts, "h").select("s", "n", "c", "fs").distinct(), "live")
    clusters = connected_components(live.select(F.col("s").alias("a"), F.col("fs").alias("b")))
    members = live.select("s", "n", "c").distinct().join(clusters, F.col("s") == F.col("node")).select("s", "n", "c", F.col("component").alias("cluster"))
    members = materialize(members, "members")
    found.append(_compare_clusters(members, sets, row_shingles))
    for t in (now, firsts, live, members):
        discard(t)
    return connected_components(reduce(DataFrame.union, found))


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", row_shingles: int = ROW_SHINGLES) -> DataFrame:
    """One row of each group of near copies; all columns stay."""
    marked = materialize(low_hashes(docs, words, id_col, text_col), "shingles")
    least = materialize(marked.groupBy("s").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "k2")).alias("r")), "least")
    low = materialize(marked.select("s", "n", "fp", "low").dropDuplicates(["s"]), "low")
    keys = materialize(marked.select("k", "k2"), "keys")
    discard(marked)
    places = meeting_places(low)
    marks = materialize(low.select("s", "fp").join(places.select("s").distinct(), "s", "left_semi"), "marks")
    discard(low)
    wanted = least.join(places.select("s").distinct(), "s").select("r.k", "r.k2", "s")
    sets = materialize(whole_sets(docs, wanted, words, id_col, text_col), "sets")
    named = groups(places, sets, marks, row_shingles)
    of_group = least.join(named, least.s == named.node, "left").groupBy(F.coalesce("component", "s").alias("c")).agg(F.min("r").alias("r"))
    kept = keep_keys(docs, keys, of_group.select("r.k", "r.k2"), id_col, text_col)
    for t in (least, keys, places, marks, sets):
        discard(t)
    return kept
