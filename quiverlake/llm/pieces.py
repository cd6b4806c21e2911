"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut into words where no piece of the vocabulary can join two signs.  The symbols of many words lie in
one flat numpy array.  Each round finds the best (least) rank of a pair for every word, merges all pairs of that
rank at once, leftmost first where they overlap, and closes the gaps; it ends when no word has a pair left.

* A piece may be part of a piece of better or equal rank.  Then the next merge may have to come before the other
  merges of the same round, so such pieces are merged one at a time, the leftmost of the word.
* In a word of more than ``LONG`` symbols a round would merge one rank only.  There a pair is merged when its
  rank is the least of its neighbourhood instead: nothing outside can reach it earlier, since what grows into
  it would have to be one piece, and the longest piece is shorter than the neighbourhood.
* Runs of the space sign are cut into the longest piece of spaces where the vocabulary lets them (tested for
  every remainder when a model is loaded).

Words that have been encoded are kept in a bounded cache of each worker, as ranges of a flat array of ids.

Defined results: a null or empty text has the begin and the end id alone and decodes to the empty text; rows with
equal ids or texts each give a result of their own; texts and words of any length are encoded whole; signs
outside the vocabulary become the bytes of their UTF-8 form; bytes that are no UTF-8 decode to U+FFFD each;
columns besides id and text are left out, so that their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as files

from quiverlake.llm.common import _slices, text_of

#: The sign that stands for a space (fixed value).
SPACE = "▁"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words of more symbols are merged by neighbourhoods.
LONG = 48
#: Entries and ids of the cache of a worker; longer words are forgotten at once.
CACHE_WORDS, CACHE_IDS = 120_000, 1_500_000
#: Signs of texts that are looked at together.
STEP = 1 << 20
#: Texts that are looked at together.
_ROWS = 64

_NONE = np.int32((1 << 31) - 1)
#: Entries of the cache that aren't words.
_BEGIN, _END = "\x00begin", "\x00end"


def _one_mark_a_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("mark-each-byte", _one_mark_a_byte)


def _window_least(a: np.ndarray, before: int, after: int) -> np.ndarray:
    """Least value of ``a[i - before : i + after + 1]`` for each i."""
    size = before + after + 1
    out = np.concatenate([np.full(before, _NONE, a.dtype), a, np.full(after, _NONE, a.dtype)])
    width = 1
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(a)], out[size - width : size - width + len(a)])


class PieceModel:
    """Pieces, ranks and pairs of a model file of BPE kind."""

    def __init__(self, path: str):
        spec = files.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if spec.trainer_spec.model_type != 2 or not plain or spec.trainer_spec.treat_whitespace_as_suffix or {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must be of BPE kind with an identity normaliser and no unused or user-defined pieces")
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.size = len(self.pieces)
        self.begin, self.end = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self.unknown_text = spec.trainer_spec.unk_surface or " ⁇ "
        self.bytes = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("the model must know every byte")
        ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        scores = np.array([p.score for p in spec.pieces])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.longest = max(map(len, ids))

        pairs: dict[int, int] = {}
        unsafe: set[int] = set()
        for whole, z in ids.items():
            for k in range(1, len(whole)):
                a, b = ids.get(whole[:k]), ids.get(whole[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = z
                    unsafe.update(int(self.rank[x]) for x in (a, b) if self.rank[z] <= self.rank[x] and len(self.pieces[x]) > 1)
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.unsafe = np.zeros(self.size + 1, bool)
        self.unsafe[list(unsafe)] = True

        # the symbol of each sign: its piece, or a number above all pieces
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.words = self._word_rule([p for p in ids if len(p) > 1])
        self.space_block = self._space_block(ids)
        self.too_many = SPACE * (3 * self.space_block + 1) if self.space_block else None

    @staticmethod
    def _word_rule(long: list[str]) -> re.Pattern:
        """Spaces and the signs after them that pieces may join: letters, other signs, or one sign by itself."""
        joined = {c for p in long for c in p} - {SPACE}
        kinds = [{c for c in joined if c.isalpha()}, {c for c in joined if not c.isalpha()}]
        if any(a.isalpha() != b.isalpha() for p in long for a, b in zip(p, p[1:]) if SPACE not in (a, b)):
            kinds = [joined]
        classes = ["".join(map(re.escape, sorted(k))) for k in kinds if k]
        return re.compile("|".join([*(f"{SPACE}*[{c}]+" for c in classes), f"{SPACE}+", f"[^{''.join(classes)}{SPACE}]"]))

    def _space_block(self, ids: dict[str, int]) -> int:
        """Length of the piece into which the front of every long run of spaces is merged, or 0."""
        alone = [p for p in ids if p.strip(SPACE) == ""]
        most = max(map(len, alone), default=0)
        worst = max((int(self.rank[i]) for p, i in ids.items() if p not in alone), default=-1)
        fixed = most > 1 and all(self.rank[ids[p]] > worst for p in alone) and not any(p.startswith(2 * SPACE) and p.strip(SPACE) for p in ids)
        if fixed:
            block = ids[SPACE * most]
            for n in range(2 * most + 1, 5 * most):
                found, rest = self.merge([SPACE * n])[0], self.merge([SPACE * (n - most)])[0]
                if found[0] != block or not np.array_equal(found[1:], rest):
                    return 0
        return most if fixed else 0

    def cut(self, text: str) -> list[str]:
        """Words of a text; no merge joins signs of two of them."""
        spaced = SPACE + text.replace(" ", SPACE) if text else ""
        found = self.words.findall(spaced)
        if self.too_many and self.too_many in spaced:
            return list(chain.from_iterable(map(self._cut_spaces, found)))
        return found

    def _cut_spaces(self, word: str) -> list[str]:
        """A long run of spaces in blocks; at least two blocks stay with what follows."""
        n = len(word) - len(word.lstrip(SPACE))
        blocks = max(0, n // self.space_block - 2)
        return [word[: self.space_block]] * blocks + [word[blocks * self.space_block :]]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left * np.int64(self.size) + right
        key[(left >= self.size) | (right >= self.size)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        signs = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols, word = self.symbol[signs], np.repeat(np.arange(len(words)), sizes)
        long = sizes[word] > LONG
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for local in (False, True):
            pick = long == local
            if pick.any():
                self._rounds(symbols[pick], word[pick], local, done)
        ids, word = (np.concatenate(x) for x in zip(*done)) if done else (symbols, word)
        order = np.argsort(word, kind="stable")
        ids, word = ids[order], word[order]
        if (ids >= self.size).any():
            ids, word = self._spell(ids, word)
        return ids, np.bincount(word, minlength=len(words))

    def _spell(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs outside the vocabulary as the ids of their bytes."""
        spelt = {s: [self.bytes[b] for b in chr(s - self.size).encode("utf-8")] for s in np.unique(ids[ids >= self.size]).tolist()}
        times = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids >= self.size)
        lists = [spelt[s] for s in ids[odd].tolist()]
        times[odd] = list(map(len, lists))
        out = np.repeat(ids, times)
        out[np.repeat(ids >= self.size, times)] = list(chain.from_iterable(lists))
        return out, np.repeat(word, times)

    def _rounds(self, symbols: np.ndarray, word: np.ndarray, local: bool, done: list) -> None:
        made = np.append(self._pairs(symbols[:-1], symbols[1:]), -1).astype(np.int32)
        made[:-1][word[1:] != word[:-1]] = -1
        rank = np.where(made >= 0, self.rank[made], _NONE)
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(heads, append=len(word))
            live = least < _NONE
            if not live.all():
                stay = np.repeat(live, sizes)
                done.append((symbols[~stay], word[~stay]))
                symbols, word, made, rank = symbols[stay], word[stay], made[stay], rank[stay]
                least, sizes = least[live], sizes[live]
                if not len(symbols):
                    return
            floor = _window_least(rank, self.longest, self.longest) if local else np.repeat(least, sizes)
            at = np.flatnonzero((rank == floor) & (rank < _NONE))
            at = self._apart(rank, word, at, local)
            # the merges, and the gaps closed
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols[at] = made[at]
            symbols, word, made, rank = symbols[stay], word[stay], made[stay], rank[stay]
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            new = np.full(len(touched), -1, np.int32)
            inner = touched + 1 < len(symbols)
            inner[inner] = word[touched[inner]] == word[touched[inner] + 1]
            new[inner] = self._pairs(symbols[touched[inner]], symbols[touched[inner] + 1])
            made[touched] = new
            rank[touched] = np.where(new >= 0, self.rank[new], _NONE)

    def _apart(self, rank: np.ndarray, word: np.ndarray, at: np.ndarray, local: bool) -> np.ndarray:
        """Of the pairs ``at``, those that can be merged together: every second one of a row of neighbours."""
        number = np.arange(len(at))
        first = np.concatenate([[True], np.diff(at) != 1])
        begin = np.maximum.accumulate(np.where(first, number, 0))
        keep = (number - begin) % 2 == 0
        if local:
            # the row of equal pairs must be known from its first one on
            head = at[begin]
            keep &= ~((head > 0) & (rank[np.maximum(head - 1, 0)] == rank[head]))
        at = at[keep]
        one = self.unsafe[rank[at]]
        if one.any():
            if local:
                behind = _window_least(np.concatenate([[_NONE], rank[:-1]]), self.longest - 1, 0)
                at = at[~one | (behind[at] > rank[at])]
            else:
                lead = np.concatenate([[True], word[at][1:] != word[at][:-1]])
                at = at[lead | ~one]
        return at


class PieceEncoder:
    """Texts to ids, through a cache of words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.used = self.count = 0
        self._keep([_BEGIN, _END], np.array([self.model.begin, self.model.end], np.int32), np.ones(2, np.int64))

    def _keep(self, words: Sequence[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(words), len(ids)
        while self.count + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.sizes[self.count : self.count + n] = sizes
        self.starts[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = ids
        self.number.update(zip(words, range(self.count, self.count + n)))
        self.count += n
        self.used += total

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, with begin and end ids, and the number of ids of each."""
        words: list[str] = []
        counts = []
        for t in texts:
            found = self.model.cut(t)
            words.append(_BEGIN)
            words += found
            words.append(_END)
            counts.append(len(found) + 2)
        numbers = list(map(self.number.get, words))
        missed = [k for k, x in enumerate(numbers) if x is None]
        fresh = list(dict.fromkeys(map(words.__getitem__, missed)))
        if fresh:
            self._keep(fresh, *self.model.merge(fresh))
            for k in missed:
                numbers[k] = self.number[words[k]]
        at = np.array(numbers, np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(counts) - 1
        lengths = np.diff(ends[last], prepend=0) if len(texts) else np.zeros(0, np.int64)
        if self.count > CACHE_WORDS or self.used > CACHE_IDS:
            self._clear()
        else:
            for w in fresh:
                if len(w) > LONG:
                    del self.number[w]
        return flat, lengths


class PieceDecoder:
    """Ids to text: pieces in their UTF-8 form, bytes as they are, read as one stream.

    A control id has no text and ends a character that bytes have begun.
    """

    def __init__(self, path: str):
        m = PieceModel(path)
        self.form = [
            b"" if k == CONTROL else m.unknown_text.encode("utf-8") if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode("utf-8")
            for p, k in zip(m.pieces, m.kinds)
        ]
        self.control = {i for i, k in enumerate(m.kinds) if k == CONTROL}
        self.spaced = {i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == NORMAL and p.startswith(SPACE)}

    def decode(self, ids: Sequence[int]) -> str:
        marks = [k for k, i in enumerate(ids) if i in self.control] if not self.control.isdisjoint(ids[1:-1]) else []
        cuts = [0, *marks, len(ids)]
        text = "".join(b"".join(map(self.form.__getitem__, ids[a:b])).decode("utf-8", "mark-each-byte") for a, b in zip(cuts, cuts[1:]))
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first in self.spaced else text


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def _decoder(path: str) -> PieceDecoder:
    return PieceDecoder(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, a few million signs at a time or one text."""
    group: list[str] = []
    held = 0
    for t in texts:
        if group and held + len(t) > STEP:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """Rows ``(id, ids, decoded string)`` for every whole text; no shuffle, one pass.

    ``path`` is a model file that executors can read.  ``ids`` is an array of int, or, ``packed``, the ids as
    little-endian unsigned 32-bit integers in one binary value.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _encoder(path), _decoder(path)
        for batch in batches:
            for b in _slices([batch], _ROWS):
                at = 0
                for texts in _groups(b.column(1).to_pylist()):
                    flat, sizes = enc.encode(texts)
                    ends = np.cumsum(sizes)
                    listed = flat.tolist()
                    decoded = [dec.decode(listed[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                    if packed:
                        raw = memoryview(flat.astype("<u4").tobytes())
                        ids = pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())
                    else:
                        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), ids, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])
                    at += len(texts)

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return given.mapInArrow(run, f"id {kind}, ids {'binary' if packed else 'array<int>'}, decoded string").withColumnRenamed("id", id_col)


def roundtrip_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the packed ids and of the decoded text."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
