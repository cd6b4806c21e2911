"""Periodic runs of words by internal pattern matching.

Words of many documents become one array of symbols that differ between documents.  Prefix doubling sorts the
places by their next 1, 2, 4, ... words (places whose words occur once are settled and not sorted again): this is
the suffix array, the interval of each dyadic block in it, and a name for each block of 2^k words.

A run of period q with b <= q < 2b, b = 2^k, and at least 4q words holds a whole block of b words that begins at
a multiple of b, and the block again q words later.  So for each such block that occurs three times or more, a
wavelet matrix over the suffix array is asked for the block's first three occurrences in the window of b places
that begins b places on (range successor).  One or two occurrences give a candidate period each.  Three or more
form a progression whose difference p is the period of the block; then the stretches of period p around the block
and around its first occurrence must end alike, which leaves one candidate.  A candidate is extended to both
sides by the names of blocks; equal stretches keep their smallest period.  A period of one word needs no window:
the next word is equal or not.

Defined results: a null or empty text has no words and no runs; rows with equal ids or texts each give a result
of their own; a null id counts as the empty text when ids are hashed; texts are looked at whole, in memory in
proportion to the longest text times the logarithm of its longest repeat; of runs with equal exponent the one of
smallest start, then period, is named; columns besides id and text are left out, so that their names can't clash;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import map_rows, text_of

#: A run has at least ``LEAST`` words and ``TIMES`` periods.
LEAST, TIMES = 6, 4
#: Words of documents that are looked at together.
TOGETHER = 1 << 18


class PlaceOrder:
    """Wavelet matrix over a list of distinct places, for range successors."""

    def __init__(self, places: np.ndarray):
        self.sorted = np.sort(places)
        values = np.searchsorted(self.sorted, places)
        self.planes = max(1, int(len(places)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(self.planes - 1, -1, -1):
            bit = (values >> b) & 1 == 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest place at or above ``least`` in the stretch from ``low`` to before ``high``, or -1."""
        bound = np.searchsorted(self.sorted, least)
        below = np.zeros(len(low), np.int64)
        a, z = low.astype(np.int64), high.astype(np.int64)
        for level, b in enumerate(range(self.planes - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one_a, one_z = ones[a].astype(np.int64), ones[z].astype(np.int64)
            up = (bound >> b) & 1 == 1
            below += np.where(up, (z - one_z) - (a - one_a), 0)
            a, z = np.where(up, zeros + one_a, a - one_a), np.where(up, zeros + one_z, z - one_z)
        # the value of that rank within the stretch
        found = (below < high - low) & (bound < len(self.sorted))
        rank, a, z = below[found], low[found].astype(np.int64), high[found].astype(np.int64)
        value = np.zeros(len(rank), np.int64)
        for level, b in enumerate(range(self.planes - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one_a, one_z = ones[a].astype(np.int64), ones[z].astype(np.int64)
            zero = (z - one_z) - (a - one_a)
            up = rank >= zero
            rank = np.where(up, rank - zero, rank)
            value |= up.astype(np.int64) << b
            a, z = np.where(up, zeros + one_a, a - one_a), np.where(up, zeros + one_z, z - one_z)
        out = np.full(len(low), -1, np.int64)
        out[found] = self.sorted[value]
        return out


class Blocks:
    """Names, suffix array intervals and extensions of the dyadic blocks of a text of symbols."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        order = np.argsort(text, kind="stable")
        first = np.concatenate([[True], text[order][1:] != text[order][:-1]])
        self.places = order
        self.names: list[np.ndarray] = []  # for each k: where the group of a block of 2^k words begins in the suffix array
        self.sizes: list[np.ndarray] = []  # and the size of the group
        slots, names, sizes = np.arange(n), np.empty(n, np.int64), np.ones(n, np.int64)
        while True:
            begin = np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))
            moved = self.places[slots]
            names[moved] = slots[begin]
            heads = np.flatnonzero(first)
            sizes[moved] = np.repeat(np.diff(heads, append=len(slots)), np.diff(heads, append=len(slots)))
            self.names.append(names.astype(np.int32))
            self.sizes.append(sizes.astype(np.int32))
            if len(self.names) == 2:
                self.two = slots  # places of settled blocks of two words are never asked for
            slots = slots[sizes[moved] > 1]
            if not len(slots):
                break
            step = 1 << (len(self.names) - 1)
            here = self.places[slots]
            after = here + step
            key = names[here] * (n + 1) + np.where(after < n, names[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            self.places[slots] = here[by]
            key = key[by]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            names, sizes = names.copy(), sizes.copy()

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal symbols from the places ``x`` and ``y`` on (x < y)."""
        found = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, last = self.names[k], self.n - 1
            same = (y + found <= last) & (name[np.minimum(x + found, last)] == name[np.minimum(y + found, last)])
            found += same.astype(np.int64) << k
        return found

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal symbols that end at the places ``x`` and ``y`` (x < y)."""
        found = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, back = self.names[k], (1 << k) - 1
            same = (x - found >= back) & (name[np.maximum(x - found - back, 0)] == name[np.maximum(y - found - back, 0)])
            found += same.astype(np.int64) << k
        return found


def _candidates(blocks: Blocks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods, two words or more, that may belong to runs."""
    if len(blocks.names) < 2:
        return
    index, slot = None, None
    for k in range(1, len(blocks.names)):
        b = 1 << k
        at = np.arange(0, blocks.n, b)
        at = at[blocks.sizes[k][at] >= 3]
        if not len(at):
            continue
        if index is None:
            index = PlaceOrder(blocks.places[blocks.two])
            slot = np.zeros(blocks.n + 1, np.int64)  # slots of the suffix array to those of the index
            slot[blocks.two + 1] = 1
            np.cumsum(slot, out=slot)
        low = slot[blocks.names[k][at]]
        high = low + blocks.sizes[k][at]
        found: list[np.ndarray] = []
        asked = np.arange(len(at))
        least = at + b
        for _ in range(3):
            place = np.full(len(at), -1, np.int64)
            place[asked] = index.successor(low[asked], high[asked], least[asked])
            place[place >= at + 2 * b] = -1
            found.append(place)
            asked = np.flatnonzero(place >= 0)
            least = place + 1
        one, two, three = found
        single = three < 0
        for place in (one, two):
            hit = np.flatnonzero(single & (place >= 0))
            yield at[hit], place[hit] - at[hit]
        row = np.flatnonzero(~single)
        if len(row):
            i, f, p = at[row], one[row], (two - one)[row]
            end = i + p + blocks.ahead(i, i + p)
            twin = f + p + blocks.ahead(f, f + p)
            q = twin - end
            fit = (q >= b) & (q < 2 * b)
            yield i[fit], q[fit]


def find_runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of a text of symbols, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(text) < LEAST:
        return none, none, none
    # period one: stretches of equal symbols
    edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(edge, append=len(text))
    long = size >= max(LEAST, TIMES)
    starts, lengths, periods = [edge[long]], [size[long]], [np.ones(int(long.sum()), np.int64)]
    blocks = Blocks(text)
    for i, q in _candidates(blocks):
        ahead = blocks.ahead(i, i + q)
        behind = np.where(i > 0, blocks.behind(np.maximum(i - 1, 0), i + q - 1), 0)
        length = q + ahead + behind
        fit = length >= np.maximum(LEAST, TIMES * q)
        starts.append((i - behind)[fit])
        lengths.append(length[fit])
        periods.append(q[fit])
    s, n, q = (np.concatenate(x) for x in (starts, lengths, periods))
    order = np.lexsort((q, n, s))
    s, n, q = s[order], n[order], q[order]
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])]) if len(s) else np.zeros(0, bool)
    s, n, q = s[fresh], n[fresh], q[fresh]
    order = np.lexsort((q, s))
    return s[order], n[order], q[order]


def _symbols(texts: Sequence[Sequence[bytes]]) -> np.ndarray:
    """Numbers of the words, which differ between texts."""
    total = sum(map(len, texts))
    out = np.empty(total, np.int64)
    at = 0
    for words in texts:
        last = dict(zip(words, range(at, at + len(words))))
        out[at : at + len(words)] = list(map(last.__getitem__, words))
        at += len(words)
    return out


def runs_of(texts: Sequence[Sequence[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of each text, given by its words: starts, lengths, periods."""
    s, n, q = find_runs(_symbols(texts))
    ends = np.cumsum([len(t) for t in texts])
    cut = np.searchsorted(s, ends)
    return [(s[a:z] - (e - len(t)), n[a:z], q[a:z]) for t, e, a, z in zip(texts, ends, [0, *cut], cut)]


def greatest(s: np.ndarray, n: np.ndarray, q: np.ndarray) -> int:
    """The run of greatest exact length / period; the first of equal ones."""
    best = 0
    length, period = n.tolist(), q.tolist()
    for k in np.flatnonzero(n / q >= (n / q).max() * (1 - 1e-9)).tolist():
        if length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def collapse(words: Sequence[bytes], s: np.ndarray, n: np.ndarray, q: np.ndarray) -> Sequence[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(s):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, s + n, -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def planted(words: list[bytes], mark: str) -> list[bytes]:
    """The words, of which a tenth of the texts (by the hash of ``mark``) repeat a stretch to their end."""
    n, h = len(words), zlib.crc32(mark.encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    times = -(-(n - a) // p)
    return words[:a] + (again * times)[: n - a]


def _groups(sizes: Sequence[int]) -> Iterator[range]:
    at = held = 0
    for k, n in enumerate(sizes):
        if k > at and held + n > TOGETHER:
            yield range(at, k)
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield range(at, len(sizes))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_some: bool = False) -> DataFrame:
    """Rows ``(id, runs array<struct<start, length, period>>, best struct, collapsed string)``; no shuffle.

    ``best`` is the run of greatest exponent, null without runs.  ``repeat_some`` first makes texts periodic as
    :func:`planted` says, by their ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        for b in batches:
            texts = [t.encode().split() for t in b["text"]]
            if repeat_some:
                texts = [planted(t, i) for t, i in zip(texts, b["mark"])]
            for group in _groups(list(map(len, texts))):
                some = [texts[k] for k in group]
                runs, best, left = [], [], []
                for words, found in zip(some, runs_of(some)):
                    listed = [{"start": s, "length": n, "period": q} for s, n, q in zip(*(x.tolist() for x in found))]
                    runs.append(listed)
                    best.append(listed[greatest(*found)] if listed else None)
                    left.append(b" ".join(collapse(words, *found)).decode())
                yield {"id": [b["id"][k] for k in group], "runs": runs, "best": best, "collapsed": left}

    run = "struct<start: bigint, length: bigint, period: bigint>"
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("mark"))
    return map_rows(given, rows, f"id {kind}, runs array<{run}>, best {run}, collapsed string").withColumnRenamed("id", id_col)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    return found.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: One step of the hash of ids in SQL: a byte goes in, or (-1) a bit comes out.
_CRC_STEP = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def oracle_sql() -> str:
    """The same from all pairs of equal words of a document: pairs of one distance, one after the other, are a run."""
    mark = "CAST(doc_id AS VARCHAR)"
    bits = f"flatten(list_transform(range(1, length({mark}) + 1), lambda i: list_prepend(ascii(substr({mark}, i::INT, 1))::BIGINT, list_transform(range(8), lambda j: -1::BIGINT))))"
    return f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
 xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: {_CRC_STEP}), 4294967295) AS h FROM documents),
 g AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
 p AS (SELECT doc_id, w, n, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
 m AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT doc_id, w, n, a, p, unnest(range(n)) AS i FROM p)),
 e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {TIMES}),
 l AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM e) GROUP BY doc_id, q, part),
 r AS MATERIALIZED (SELECT doc_id, s, n, min(q) AS q FROM l WHERE n >= greatest({LEAST}, {TIMES} * q) GROUP BY doc_id, s, n),
 b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n / q DESC, s, q) = 1),
 d AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS runs FROM r GROUP BY doc_id),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM m WHERE NOT EXISTS (FROM r WHERE r.doc_id = m.doc_id AND m.i >= r.s + r.q AND m.i < r.s + r.n) GROUP BY doc_id)
 SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, CAST(b.n AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.n // b.q AS BIGINT) AS exponent_milli, coalesce(d.runs, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
 FROM t LEFT JOIN b USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)"""
