"""Substring dedup: words of windows that occur anywhere else are removed.

Equal windows of ``window`` words have the same minimiser: the word group of least hash among theirs.  A
text falls into runs of windows with one minimiser; the run's words are a segment.

1.  The minimisers of all texts are counted; a window can occur twice only if its minimiser does.
2.  Segments with a repeated minimiser are grouped by minimiser and hash of their words; one of each kind
    is cut from its text, with the number of its places, and brought to the shard of the minimiser.  A
    minimiser that is hot goes to no shard: its windows are counted by two hashes of their words, with
    counts combined on the map side, and those of two places or more are stretches.
3.  Each shard builds a compressed FM-index over its segments, weighted by their places, and streams them
    through backward search: the matching length at a word is extended until fewer than two places hold
    it, and stretches as long as a window are reported as word intervals of the segment.
4.  Intervals go back to the texts, whose other words are kept.

Defined results: null and empty texts have no words; repeated rows remove each other's windows, and so do
rows with one id and different texts; texts of any length are cut by their windows; a text without a
repeated window keeps its exact text in :func:`remove_repeats`; the columns of the input stay, but for one
named like a count, which the count replaces; an empty table stays empty.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quiverlake.llm.common import add_columns, map_rows, text_of, unused
from quiverlake.llm.fmindex import FMIndex
from quiverlake.session import discard, materialize

WINDOW = 35
#: Words of the group whose hash picks the minimiser.
GROUP = 8
#: Places of a minimiser above which its windows are spread.
HOT = 10_000
#: Words of a shard's index.
SHARD_WORDS = 250_000
#: Words of a text that are looked at together, and bits of a place among them.
_PIECE = 1 << 22
_PLACE_BITS = 24
_CACHE = 400_000

_ODD = np.array([2 * xxhash.xxh64_intdigest(b"factor", k) + 1 & 0xFFFFFFFFFFFFFFFF for k in range(64)], np.uint64)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def minimisers(h: np.ndarray, lengths: np.ndarray, window: int = WINDOW, group: int = GROUP) -> tuple[np.ndarray, ...]:
    """(text, minimiser hash, first window, last window) of the runs of windows with one minimiser.

    ``h`` holds the word hashes of several texts one after the other; no window reaches over an end.  Windows
    are looked at a piece at a time, and a run ends with its piece.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    text_of_word = np.repeat(np.arange(len(lengths)), lengths)
    parts = []
    for at in range(0, max(1, len(h)), _PIECE):
        piece = h[at : at + _PIECE + window - 1]
        if len(piece) < window:
            break
        n = len(piece) - group + 1
        g = np.zeros(n, np.uint64)
        for k in range(group):
            g += piece[k : k + n] * _ODD[k]
        g ^= g >> np.uint64(31)
        g *= _ODD[63]
        g ^= g >> np.uint64(29)
        span = window - group + 1
        key = (g >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        place = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        text = text_of_word[at : at + len(place)]
        inside = np.nonzero(np.arange(at + window, at + window + len(place)) <= ends[text])[0]
        if not len(inside):
            continue
        place, text = place[inside], text[inside]
        first = np.concatenate([[0], np.nonzero((place[1:] != place[:-1]) | (text[1:] != text[:-1]))[0] + 1])
        last = np.concatenate([first[1:], [len(place)]]) - 1
        begin = starts[text[first]] - at
        parts.append((text[first], g[place[first]].view(np.int64), inside[first] - begin, inside[last] - begin))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.xxhash64(id_col, text).alias("k"), F.crc32(text.cast("binary")).alias("k2"), text.alias("text"))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _run_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words of each run, wherever it stands in ``h``: a polynomial in an odd base, by prefix sums."""
    base = int(_ODD[62])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(np.uint64(base), len(h)), dtype=np.uint64)])
    back = _powers(np.uint64(pow(base, -1, 1 << 64)), len(h))
    part = (sums[last + window] - sums[first]) * back[first]
    part ^= part >> np.uint64(32)
    return (part * _ODD[61]).view(np.int64)


def _run_table(keyed: DataFrame, window: int) -> DataFrame:
    """Runs ``(k, k2, m, h, first, last)`` of every text: minimiser, hash of the words, windows."""

    def rows(batches):
        hashes = _WordHashes()
        for b in batches:
            texts = [words_of(t) for t in b["text"]]
            lengths = np.array([len(w) for w in texts], np.int64)
            h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), np.uint64, int(lengths.sum()))
            text, m, first, last = minimisers(h, lengths, window)
            begin = (np.cumsum(lengths) - lengths)[text]
            yield {"k": np.array(b["k"], np.int64)[text], "k2": np.array(b["k2"], np.int64)[text], "m": m, "h": _run_hashes(h, first + begin, last + begin, window), "first": first, "last": last}

    return map_rows(keyed, rows, "k long, k2 long, m long, h long, first int, last int")


def _segments(texts: DataFrame, window: int) -> DataFrame:
    """Cut one run of each kind from its text; ``at`` is the place in the run.

    Of a hot run each window is a row without words but with two hashes of them, ``w`` and ``w2``.
    """

    def rows(batches):
        names = ("m", "h", "at", "n", "w", "w2", "words")
        for b in batches:
            out = []
            for text, runs in zip(b["text"], b["runs"]):
                words = words_of(text)
                for r in runs:
                    first, last = r["first"], r["last"]
                    if not r["hot"]:
                        out.append((r["m"], r["h"], 0, r["n"], None, None, b" ".join(words[first : last + window]).decode("utf-8", "surrogatepass")))
                        continue
                    for at in range(first, last + 1):
                        part = b" ".join(words[at : at + window])
                        out.append((r["m"], r["h"], at - first, r["n"], xxhash.xxh64_intdigest(part) >> 1, xxhash.xxh64_intdigest(part, 1) >> 1, None))
            yield {n: [o[k] for o in out] for k, n in enumerate(names)}

    return map_rows(texts, rows, "m long, h long, at int, n long, w long, w2 long, words string")


def _hot_hits(hot: DataFrame, window: int) -> DataFrame:
    """Rows ``(m, h, spans)``, one for each hot run with windows that have two places or more; a run has no
    more windows than a window has word groups."""
    # rows of one document that repeat cut the same window again
    windows = materialize(hot.groupBy("m", "h", "at").agg(F.max("n").alias("n"), F.max("w").alias("w"), F.max("w2").alias("w2")), "windows")
    twice = materialize(windows.groupBy("w", "w2").agg(F.sum("n").alias("places")).where("places > 1").select("w", "w2"), "twice")
    span = F.struct(F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    return windows.join(twice, ["w", "w2"]).groupBy("m", "h").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def repeated_stretches(segments: list[str], counts: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Word intervals of each segment that lie in windows with two places or more, by an FM-index.

    Each segment is streamed from its end: the stretch that ends there is extended as far as two places
    hold it.  If it is as long as a window it is reported, and the stream goes on at the last window that
    begins before it; if not, at the word before the end.
    """
    parts = [s.encode("utf-8", "surrogatepass").split() for s in segments]
    names: defaultdict[bytes, int] = defaultdict(count(2).__next__)
    lengths = np.array([len(p) for p in parts])
    text = np.ones(int(lengths.sum()) + len(parts), np.int64)  # 1 parts segments
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    flat = np.fromiter(map(names.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
    inside = np.ones(len(text), bool)
    inside[starts + lengths] = False
    text[inside] = flat
    index = FMIndex(text, np.repeat(counts, lengths + 1))
    found: list[list[tuple[int, int]]] = [[] for _ in parts]
    live = np.nonzero(lengths >= window)[0]
    ends = starts[live] + lengths[live] - 1
    while len(live):
        reach = index.matching_lengths(ends, ends - starts[live] + 1)
        long = reach >= window
        for o, a, b in zip(live[long].tolist(), (ends - reach + 1 - starts[live])[long].tolist(), (ends + 1 - starts[live])[long].tolist()):
            found[o].append((a, b))
        ends = np.where(long, ends - reach + window - 1, ends - 1)
        more = ends - window + 1 >= starts[live]
        live, ends = live[more], ends[more]
    return found


def repeated_intervals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(k, k2, spans array<struct<a, b>>)`` for the texts that hold repeated windows."""
    keyed = _keyed(docs, text_col, id_col)
    runs = materialize(_run_table(keyed, window), "runs")
    often = runs.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m", (F.col("n") > HOT).alias("hot"))
    # written first, so that the join has exchanges of its own whose hot parts can be split
    often = materialize(often, "often")
    repeated = materialize(runs.join(often, "m"), "repeated")
    discard(runs)
    discard(often)
    kinds = repeated.groupBy("m", "h").agg(F.count("*").alias("n"), F.min(F.struct("k", "k2", "first", "last", "hot")).alias("r"))
    wanted = materialize(kinds.groupBy("r.k", "r.k2").agg(F.collect_list(F.struct("r.first", "r.last", "r.hot", "m", "h", "n")).alias("runs")), "wanted")
    words, any_hot = wanted.select(F.explode("runs").alias("r")).agg(F.sum(F.when(~F.col("r.hot"), F.col("r.last") - F.col("r.first") + window)), F.max("r.hot")).first()
    shards = max(1, -(-(words or 0) // SHARD_WORDS))
    segments = _segments(keyed.join(wanted, ["k", "k2"]).select("text", "runs"), window)
    if any_hot:
        segments = materialize(segments, "segments")

    def search(table):
        given = {n: table[n].to_pylist() for n in ("m", "h", "at", "words", "n")}
        first: dict[tuple, int] = {}  # rows of one document that repeat cut the same segment again
        for k, key in enumerate(zip(given["m"], given["h"], given["at"])):
            first.setdefault(key, k)
        pick = list(first.values())
        found = repeated_stretches([given["words"][k] for k in pick], np.array([given["n"][k] for k in pick]), window)
        hits = [(given["m"][k], given["h"][k], [{"a": a + given["at"][k], "b": b + given["at"][k]} for a, b in f]) for k, f in zip(pick, found) if f]
        return pa.table({n: [x[k] for x in hits] for k, n in enumerate(("m", "h", "spans"))}, schema=pa.schema([("m", pa.int64()), ("h", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    cold = segments.where("words IS NOT NULL")
    hits = cold.select("m", "h", "at", "n", "words", F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(search, "m long, h long, spans array<struct<a int, b int>>")
    if any_hot:
        hits = hits.union(_hot_hits(segments.where("words IS NULL"), window))
    hits = materialize(hits, "hits")
    if any_hot:
        discard(segments)
    # one row for each repeated run, with its stretches if there are any
    placed = repeated.select("k", "k2", "first", "m", "h").join(hits, ["m", "h"], "left")
    shifted = F.transform("spans", lambda s: F.struct((s.a + F.col("first")).alias("a"), (s.b + F.col("first")).alias("b")))
    spans = placed.groupBy("k", "k2").agg(F.array_sort(F.flatten(F.collect_list(shifted))).alias("spans"))
    return materialize(spans.where(F.size("spans") > 0), "spans")


def _keep(words: list[bytes], spans: list[dict]) -> list[bytes]:
    kept, at = [], 0
    for s in spans:
        kept += words[at : max(at, s["a"])]
        at = max(at, s["b"])
    return kept + words[at:]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the kept words, joined by one space, and the columns
    ``counts``: words and removed words.  A text that loses nothing stays as it is."""
    text = text_of(text_col)
    k, k2, marked = unused(docs, "k", "k2", "spans")
    given = docs.withColumns({k: F.xxhash64(id_col, text), k2: F.crc32(text.cast("binary"))})
    spans = repeated_intervals(docs, window, id_col, text_col).toDF(k, k2, marked)
    joined = given.join(spans, [k, k2], "left").drop(k, k2)

    def compute(texts: list, marks: list) -> dict:
        out = {text_col: [], counts[0]: [], counts[1]: []}
        for t, s in zip(texts, marks):
            words = words_of(t or "")
            kept = _keep(words, s) if s else words
            out[text_col].append(b" ".join(kept).decode("utf-8", "surrogatepass") if s else t)
            out[counts[0]].append(len(words))
            out[counts[1]].append(len(words) - len(kept))
        return out

    fields = StructType([StructField(text_col, StringType()), *[StructField(c, LongType()) for c in counts]])
    return add_columns(joined, [text_col, marked], fields, compute, drop=(marked,))


def removal_digests(reduced: DataFrame) -> DataFrame:
    """Counts, and the digest of the kept words joined by one space."""
    words = F.trim(F.regexp_replace(text_of(), r"[\x20\x09-\x0D]+", " "))
    return reduced.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
