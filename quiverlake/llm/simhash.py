"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint bit is set where it is set in over half of the hashes of a text's word shingles.  Distinct
fingerprints within ``bits`` differing bits agree on at least one of ``bits + 1`` masks of adjacent bits.
For each mask, fingerprints meet by their bits under the mask; there they are sorted by Gray rank, so that
neighbours share most bits, and groups of eight become nodes that keep the bits all members share.  Two
nodes are compared by the shared bits alone: differences only grow on the way down, so a pair of nodes with
too many is dropped with all its leaves, and a pair that cannot have too many is linked whole.  Links leave
a task as a forest (at most one a fingerprint), and the components of all forests are the groups.

A hot mask value is dealt out over several tiles; every pair of tiles is compared by one task.

Defined results: null and empty texts and texts of white space have fingerprint zero and are linked like
any other; fewer words than a shingle give one shingle; repeated shingles count repeatedly; rows with equal
texts share a fingerprint; the component is the smallest non-null id that links reach.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import keep_keys, map_rows, row_keys, text_of
from quiverlake.llm.components import connected_components, with_smallest
from quiverlake.session import materialize

WORDS = 4
BITS = 4
#: Fingerprints of one mask value that meet in one tile.
TILE = 4096
_FAN = 8
#: Node pairs that are expanded at once; bounds memory, not results.
_STEP = 200_000


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the ASCII-lower-cased words, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(whole, 42)], np.uint64)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    return np.fromiter((h(whole[a : b - 1], 42) for a, b in zip(starts, starts[words:])), np.uint64, len(parts) - words + 1)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; zero without hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits of the shingle hashes, as a signed 64-bit number."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, fp long)``; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        for b in batches:
            yield {"id": b["id"], "fp": [fingerprint(t, words) for t in b["text"]]}

    return map_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), rows, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def masks(bits: int) -> list[int]:
    """``bits + 1`` masks that part the 64 bits."""
    cuts = [round(64 * k / (bits + 1)) for k in range(bits + 2)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, shared mask) of the nodes of each level, leaves first; codes are in Gray order."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(codes, np.full(len(codes), full))]
    while len(levels[-1][0]) > 1:
        p, m = levels[-1]
        at = np.arange(0, len(p), _FAN)
        ones, zeros = np.bitwise_and.reduceat(p & m, at), np.bitwise_and.reduceat(~p & m, at)
        levels.append((ones, ones | zeros))
    return levels


class _Forest:
    """Union of positions; keeps the least position of each set as its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs, all at once: roots of pairs are hung below each other until no pair is apart."""
        while True:
            x, y = self.up[a], self.up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            while True:
                above = self.up[self.up]
                if (above == self.up).all():
                    break
                self.up = above


def join_tiles(left: np.ndarray, right: np.ndarray | None, bits: int = BITS) -> list[tuple[int, int]]:
    """Forest of the links within ``left``, or between ``left`` and ``right``: pairs of codes.

    Codes are distinct; the result joins all that links of at most ``bits`` differing bits join.
    """
    own = right is None
    one = np.sort(left.view(np.uint64))
    one = one[np.argsort(gray_rank(one), kind="stable")]
    two = one if own else right.view(np.uint64)[np.argsort(gray_rank(right.view(np.uint64)), kind="stable")]
    a_levels, b_levels = _levels(one), _levels(two)
    depth = max(len(a_levels), len(b_levels))
    for levels in (a_levels, b_levels):
        while len(levels) < depth:
            levels.append(levels[-1])
    span = [_FAN**k for k in range(depth)]
    forest = _Forest(len(one) + (0 if own else len(two)))
    shift = 0 if own else len(one)
    todo = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        if len(a) > _STEP:
            for k in range(0, len(a), _STEP):
                todo.append((level, a[k : k + _STEP], b[k : k + _STEP]))
            continue
        (pa, ma), (pb, mb) = a_levels[level], b_levels[level]
        shared = ma[a] & mb[b]
        far = np.bitwise_count((pa[a] ^ pb[b]) & shared)
        near = far <= bits
        if level == 0:
            near &= (a != b) if own else True
            forest.link(a[near], b[near] + shift)
            continue
        sure = near & (far + np.bitwise_count(~shared) <= bits)
        for x, y in zip(a[sure].tolist(), b[sure].tolist()):
            xs = np.arange(x * span[level], min((x + 1) * span[level], len(one)))
            ys = np.arange(y * span[level], min((y + 1) * span[level], len(two))) + shift
            forest.link(np.full(len(xs), ys[0]), xs)
            forest.link(np.full(len(ys), xs[0]), ys)
        a, b = a[near & ~sure], b[near & ~sure]
        below = level - 1
        na, nb = len(a_levels[below][0]), len(b_levels[below][0])
        if na == len(pa) and nb == len(pb) and na == nb == 1:  # a padded level of single roots
            todo.append((below, a, b))
            continue
        k = np.arange(_FAN)
        ca = a[:, None] * _FAN + k if na > len(pa) or len(pa) > 1 else np.where(k == 0, a[:, None], na)
        cb = b[:, None] * _FAN + k if nb > len(pb) or len(pb) > 1 else np.where(k == 0, b[:, None], nb)
        xa, xb = np.repeat(ca, _FAN, axis=1).ravel(), np.tile(cb, (1, _FAN)).ravel()
        fit = (xa < na) & (xb < nb)
        if own:
            fit &= xa <= xb
        if fit.any():
            todo.append((below, xa[fit], xb[fit]))
    codes = np.concatenate([one, two]) if not own else one
    signed, roots = codes.view(np.int64), forest.roots()
    below = np.nonzero(roots != np.arange(len(signed)))[0]
    return list(zip(signed[below].tolist(), signed[roots[below]].tolist()))


def link_fingerprints(fps: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that join all distinct fingerprints ``fp`` within ``bits`` differing bits."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(m))), _low(m)).alias("v")) for i, m in enumerate(masks(bits))]))
    keyed = fps.select("fp", keys.alias("k")).select("fp", "k.mask", "k.v")
    sizes = keyed.groupBy("mask", "v").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1")
    tiles = F.coalesce("tiles", F.lit(1))
    dealt = keyed.join(sizes, ["mask", "v"], "left").select("fp", "mask", "v", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("own"))
    # tile i meets each tile j >= i: a code goes to the pairs (own, j) and (i, own)
    pairs = F.when(F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    )
    met = dealt.select("fp", "mask", "v", "own", F.explode(pairs).alias("p")).select("fp", "mask", "v", "own", "p.i", "p.j")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = met.repartition(parts, "mask", "v", "i", "j").sortWithinPartitions("mask", "v", "i", "j")

    def rows(batches):
        key, left, right = None, [], []
        for b in batches:
            edges = []
            for fp, *k, own in zip(b["fp"], b["mask"], b["v"], b["i"], b["j"], b["own"]):
                if k != key:
                    edges += _links(left, right, bits)
                    key, left, right = k, [], []
                (left if own == k[2] else right).append(fp)
            yield {"a": [e[0] for e in edges], "b": [e[1] for e in edges]}
        edges = _links(left, right, bits)
        yield {"a": [e[0] for e in edges], "b": [e[1] for e in edges]}

    return map_rows(placed, rows, "a long, b long", 8192)


def _links(left: list[int], right: list[int], bits: int) -> list[tuple[int, int]]:
    if len(left) + len(right) < 2 or (right and not left):
        return []
    if not right and len(left) <= 3:  # too few for a tree
        return [(a, b) for k, a in enumerate(left) for b in left[k + 1 :] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits]
    return join_tiles(np.array(left, np.int64), np.array(right, np.int64) if right else None, bits)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _low(m: int) -> int:
    return (m & -m).bit_length() - 1


def components(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Rows ``(doc_id, fp long, component_id)`` for every document."""
    marked = materialize(fingerprints(docs, words), "simhash")
    fps = marked.select("fp").distinct()
    groups = connected_components(link_fingerprints(fps, bits))
    named = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    in_group = named.join(groups, named.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of_fp = with_smallest(in_group, "component", "least", "fp").select("fp", F.col("smallest").alias("component_id"))
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Exactly one row of each group, that of the smallest id (null last); all columns stay.

    Where rows repeat, or share the smallest id, one of them is kept.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for b in batches:
            yield {"k": b["k"], "k2": b["k2"], "id": b["id"], "fp": [fingerprint(t, words) for t in b["text"]]}

    given = docs.select(*[c.alias(n) for n, c in row_keys().items()], F.col("doc_id").alias("id"), text_of().alias("text"))
    marked = materialize(map_rows(given, rows, f"k long, k2 long, id {kind}, fp long"), "simhash")
    groups = connected_components(link_fingerprints(marked.select("fp").distinct(), bits))
    least = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "k2")).alias("r"))
    of_group = least.join(groups, least.fp == groups.node, "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("r").alias("r"))
    return keep_keys(docs, marked.select("k", "k2"), of_group.select("r.k", "r.k2"))
