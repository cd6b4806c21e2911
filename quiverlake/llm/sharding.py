"""K-d tree sharding: recursive weighted medians along the widest metadata dimension.

Law ``bytes``: shards get near equal bytes, and rows with equal texts stay together.  Groups of equal texts
are the units; their size, their smallest id and a text hash are the dimensions.  Units heavier than a
fixed part of the target are few (their number is bounded by the shard count); they are dealt out first,
heaviest first, to the lightest shard.  The rest is split: each node of the tree takes its widest dimension
and finds the point where the bytes before it match the share of its left leaves, by a histogram whose
bucket around the point is refined until it is negligible.  Only histograms reach the driver.

``shard_count`` follows from target bytes, or is given.  DataFrame functions only.

Defined results: null and empty texts have size 1 and are one unit; repeated rows share a shard and get
slots of their own; units of equal size or place are parted by the hash of their text; slots follow the id,
then checksum and size (nulls first), within a bucket; texts of any length are one unit each; columns besides
id and text are left out, so that their names can't clash; a table without rows gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.session import materialize

SHARDS = 16
#: A unit is heavy if it holds more than this part of a shard's target.
HEAVY = 1 / 64
#: Buckets of a histogram, and bits of a unit's place along a dimension.
_BUCKET_BITS = 9
_BITS = 54
#: Slots are numbered by bucket of the id hash, so that no shard is numbered by one task.
_SLOT_BUCKETS = 64
#: Rows that a bucket holds at most, more or less, where the table asks for more buckets.
_BUCKET_ROWS = 100_000

DIMS = ("by_size", "by_id", "by_text")


def shard_count(target_bytes: int, total_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / target_bytes))


def _places(units: DataFrame) -> DataFrame:
    """Each dimension as a place from 0 to 2^54: the value's place in its span, ties parted by hash."""
    values = {"by_size": F.log2(F.col("unit_rows") * 1.0 + F.col("bytes")), "by_id": F.coalesce(F.col("least_id").cast("double"), F.lit(0.0)), "by_text": F.shiftrightunsigned("h", 12).cast("double")}
    span = units.agg(*[f(values[d]).alias(f"{d}_{n}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = units
    for d in DIMS:
        lo, hi = span[f"{d}_lo"] or 0.0, span[f"{d}_hi"] or 0.0
        part = (values[d] - F.lit(lo)) / F.lit(max(hi - lo, 1e-300))
        coarse = F.least(F.floor(part * (1 << 32)), F.lit((1 << 32) - 1)).cast("long")
        out = out.withColumn(d, F.shiftleft(coarse, _BITS - 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64("h", F.lit(d)), 64 - (_BITS - 32))))
    return out


def _heavy(units: DataFrame, shards: int, total: int) -> tuple[list[tuple[int, int]], list[float]]:
    """Heavy units dealt to shards, and what each shard still wants."""
    target = total / shards
    # at most shards / HEAVY rows can be this heavy
    rows = units.where(F.col("bytes") > HEAVY * target).select("unit", "bytes").orderBy(F.desc("bytes"), "unit").collect()
    load, dealt = [0] * shards, []
    for r in rows:
        k = min(range(shards), key=lambda s: (load[s], s))
        load[k] += r.bytes
        dealt.append((r.unit, k))
    # level the rest: shards above the common level want nothing
    rest = total - sum(load)
    order, level, taken = sorted(load), 0.0, 0
    for k, x in enumerate(order):
        taken += x
        level = (rest + taken) / (k + 1)
        if k + 1 == shards or level <= order[k + 1]:
            break
    return dealt, [max(0.0, level - x) for x in load]


def _split(units: DataFrame, wants: list[float]) -> list[tuple[int, int, str, int]]:
    """The tree: (first leaf, last leaf, dimension, cut) of each inner node, level by level."""
    inner: list[tuple[int, int, str, int, int]] = []
    frontier = [(0, len(wants) - 1)]
    while any(a < b for a, b in frontier):
        leaf = _leaf(inner)
        placed = units.withColumn("node", leaf)
        spans = {r.node: r for r in placed.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{d}_{n}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        search = {}
        for a, b in frontier:
            if a == b or a not in spans:
                continue
            s, mid = spans[a], (a + b) // 2
            widest = max(DIMS, key=lambda d: (s[f"{d}_hi"] - s[f"{d}_lo"], d))
            share = sum(wants[a : mid + 1]) / (sum(wants[a : b + 1]) or 1)
            search[a] = {"dim": widest, "lo": s[f"{widest}_lo"], "bits": max(1, int(s[f"{widest}_hi"] - s[f"{widest}_lo"]).bit_length()), "want": share * s.bytes, "bytes": s.bytes, "before": 0}
        open_nodes = dict(search)
        while open_nodes:
            value, low, width = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0)
            for a, q in open_nodes.items():
                here = F.col("node") == a
                q["step"] = max(0, q["bits"] - _BUCKET_BITS)
                value, low, width = F.when(here, F.col(q["dim"])).otherwise(value), F.when(here, F.lit(q["lo"])).otherwise(low), F.when(here, F.lit(q["step"])).otherwise(width)
            bucket = placed.select("node", "bytes", value.alias("v"), low.alias("lo"), width.cast("int").alias("w"))
            spot = F.expr("shiftright(v - lo, w)")
            counted = bucket.where(F.col("v") >= F.col("lo")).groupBy("node", spot.alias("k")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where(F.col("k") < (1 << _BUCKET_BITS) * 2)
            hist: dict[int, list] = {}
            for r in counted.collect():
                hist.setdefault(r.node, []).append((r.k, r.bytes, r.n))
            for a, q in list(open_nodes.items()):
                run = q["before"]
                for k, w, n in sorted(hist.get(a, [])):
                    if run + w < q["want"] and k < (1 << q["bits"] - q["step"]):
                        run += w
                        continue
                    q["before"], q["lo"], q["bits"] = run, q["lo"] + (k << q["step"]), q["step"]
                    if n == 1 or q["step"] == 0 or w < 1e-4 * q["bytes"]:
                        if q["want"] - run > run + w - q["want"]:  # the bucket goes to the nearer side
                            q["lo"] += 1 << q["step"]
                        del open_nodes[a]
                    break
                else:
                    del open_nodes[a]
        nxt = []
        for a, b in frontier:
            if a == b:
                continue
            mid = (a + b) // 2
            q = search.get(a)
            if q:
                inner.append((a, b, q["dim"], q["lo"], mid + 1))
            nxt += [(a, mid), (mid + 1, b)]
        frontier = nxt
    return inner


def _leaf(inner: list[tuple[int, int, str, int, int]]) -> F.Column:
    """First leaf of the node that a unit has reached, as nested conditions."""
    known = {(a, b): (d, cut, right) for a, b, d, cut, right in inner}

    def walk(a: int, b: int) -> F.Column:
        if (a, b) not in known:
            return F.lit(a)
        d, cut, right = known[a, b]
        return F.when(F.col(d) >= F.lit(cut), walk(right, b)).otherwise(walk(a, right - 1))

    return walk(0, max((b for _, b, *_ in inner), default=0))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """Rows ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every document."""
    read = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce(F.octet_length("text"), F.lit(0))).alias("h"),
        F.xxhash64(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("h2"),
    ).withColumn("unit", F.xxhash64("h", "h2", "text_crc32", "size"))
    rows = materialize(read.select("doc_id", "size", "text_crc32", "h", "unit"), "sizes")
    units = _places(rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("unit_rows"), F.min("doc_id").alias("least_id"), F.min("h").alias("h")))
    units = materialize(units.select("unit", "bytes", *DIMS), "units")
    total = units.agg(F.sum("bytes")).first()[0] or 0
    if target_bytes:
        shards = shard_count(target_bytes, total)
    dealt, wants = _heavy(units, shards, total)
    heavy = {u for u, _ in dealt}
    light = units.where(~F.col("unit").isin(*heavy)) if heavy else units
    leaf = _leaf(_split(light, wants)) if total else F.lit(0)
    if dealt:  # a bounded table, see _heavy
        fixed = docs.sparkSession.createDataFrame(dealt, "unit long, dealt int")
        placed = units.join(F.broadcast(fixed), "unit", "left").select("unit", F.coalesce("dealt", leaf).alias("shard"))
    else:
        placed = units.select("unit", leaf.alias("shard"))
    homes = rows.join(placed, "unit").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    return number_slots(homes.withColumn("law", F.lit("bytes"))).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def number_slots(homes: DataFrame) -> DataFrame:
    """Gapless slots from 0 in each shard: rank in a bucket plus the sizes of the buckets before it."""
    buckets = max(_SLOT_BUCKETS, homes.count() // _BUCKET_ROWS)
    held = materialize(homes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")), "homes")
    counts = held.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return held.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + rank - 1).cast("long")).drop("bucket", "start")
