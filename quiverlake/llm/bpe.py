"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

A merge list fixes how far to the right a byte can still change the tokens before it.  Two texts with
a common prefix keep equal tokens up to a frontier; the frontier moves left only when a merge (a, b)
takes the last common token ``a``, and the next move needs a later merge (p, q) whose right part ``q``
begins with ``a``.  The heaviest chain of such merges, weighted by the length of ``a``, bounds the
lookahead.  :meth:`MergeList.lookahead` computes it; :meth:`MergeList.stream` keeps at most two
lookaheads of symbols and emits a token as soon as it ends before the lookahead.

Words are cut by Python's character tables.  A text that these tables may put into another normal form than the
library's is cut by the normaliser and pre-tokenizer of the file itself instead: one that isn't in normal form
already, or holds a combining mark or a code point which one of the two doesn't know yet.

Defined results: a null or empty text has no ids and decodes to the empty text; rows with equal ids or texts
each give a result of their own; texts of any length are encoded whole, word by word; strings of special
tokens inside a text become their special ids, as the library does; columns besides id and text are left
out, so that their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quiverlake.llm.common import map_rows, text_of

_SPACE = r"\t-\r \x85\xa0  -     　"
#: Contractions, letters, single digits, other runs: the splitting rule of the word vocabulary (fixed value).
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: The same for texts of ASCII and Latin letters, where the plain engine is faster.
_LATIN = r"a-zß-öø-ſ"
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
_SPLIT_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\t-\r {_LATIN}0-9]+")
#: Categories of signs that tables of different age may order or join in different ways.
_UNSURE = {"Cn", "Mn", "Mc", "Me"}
#: Words longer than this are not kept in the word cache.
_LONG_WORD = 48
#: Entries of a cache generation; two generations are kept.
_CACHE = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeList:
    """Vocabulary and merges of a tokenizer file, with its sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rules = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        letters = byte_alphabet()
        self.start = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.width = {i: len(s.removesuffix(self.suffix) if self.suffix else s) for s, i in vocab.items()}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Heaviest chain of merges that can carry a change to the left, in symbols."""
        begins: dict[int, list[int]] = {}
        reach: dict[int, int] = {}
        most = 0
        for (a, b), (_, ab) in sorted(self.rules.items(), key=lambda x: x[1][0]):
            begins.setdefault(ab, []).append(a)
            seen, todo = set(), [b]
            while todo:
                t = todo.pop()
                if t not in seen:
                    seen.add(t)
                    todo += begins.get(t, ())
            weight = self.width[a] + max(reach.get(t, 0) for t in seen)
            reach[a] = max(reach.get(a, 0), weight)
            most = max(most, weight)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a bounded list of symbols."""
        if len(ids) > 40:
            return self._merge_by_heap(ids)
        rules = self.rules
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                rule = rules.get(pair)
                if rule and (best is None or rule < best):
                    best, at = rule, pair
            if best is None:
                break
            a, b = at
            out, k, n = [], 0, len(ids)
            while k < n:
                if ids[k] == a and k + 1 < n and ids[k + 1] == b:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _merge_by_heap(self, ids: list[int]) -> list[int]:
        ids, n = list(ids), len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*r, k, p) for k, p in enumerate(zip(ids, ids[1:])) if (r := self.rules.get(p))]
        heap = [(rank, k, made, p) for rank, made, k, p in heap]
        heapq.heapify(heap)
        while heap:
            _, k, made, (a, b) = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0:
                    p = (ids[left], ids[after[left]])
                    if r := self.rules.get(p):
                        heapq.heappush(heap, (r[0], left, r[1], p))
        return [i for i in ids if i >= 0]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a stream of symbols; holds two lookaheads of symbols at most."""
        held: list[int] = []
        full = 2 * self.lookahead + 64
        for s in symbols:
            held.append(s)
            if len(held) >= full:
                safe, at = len(held) - self.lookahead, 0
                for token in self.merge(held):
                    if at + self.width[token] > safe:
                        break
                    at += self.width[token]
                    yield token
                del held[:at]
        yield from self.merge(held)

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        symbols = chain((self.start[b] for b in raw[:-1]), (self.last[raw[-1]],))
        return tuple(self.stream(symbols))


class Encoder:
    """Text to ids: special strings, normal form, words, then the transducer for each word."""

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")")
        self.file = Tokenizer.from_file(path)
        self.letters = {c: b for b, c in enumerate(byte_alphabet())}
        self.known: set[str] = set()

    def _knows(self, text: str) -> bool:
        """Python's tables have all signs of the text, and its normal form is the text itself in any tables."""
        fresh = set(text).difference(self.known)
        odd = {c for c in fresh if unicodedata.category(c) in _UNSURE}
        self.known |= fresh - odd
        return not odd and unicodedata.is_normalized("NFC", text)

    def _cut_by_file(self, text: str) -> list[str]:
        pieces = self.file.pre_tokenizer.pre_tokenize_str(self.file.normalizer.normalize_str(text))
        return [bytes(map(self.letters.__getitem__, p)).decode("utf-8") for p, _ in pieces]

    def _missed(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word) or self.merges.word(word)
        if len(word) <= _LONG_WORD:
            if len(self.young) >= _CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _piece(self, text: str) -> Iterator[tuple[int, ...]]:
        if _PLAIN.fullmatch(text):
            words = _SPLIT_PLAIN.findall(text.lower())
        elif not self._knows(text):
            words = self._cut_by_file(text)
        else:
            words = _SPLIT.findall(text.replace("Σ", "σ").lower())
        for w in words:
            yield self.young.get(w) or self._missed(w)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.marks.split(text) if "<|" in text else (text,):
            if part in self.merges.special:
                out.append(self.merges.special[part])
            else:
                out.extend(chain.from_iterable(self._piece(part)))
        return out


class Decoder:
    """Ids to text by a machine whose state is the unfinished bytes of one character.

    ``spaced=True`` writes token strings joined by spaces, as a tokenizer file without a decoder asks;
    otherwise tokens become their bytes and word ends become spaces.
    """

    STEP = 8192

    def __init__(self, path: str, spaced: bool = True):
        m = MergeList(path)
        if spaced:
            self.bytes = {i: (" " + s).encode("utf-8") for i, s in m.names.items()}
        else:
            back = {c: b for b, c in enumerate(byte_alphabet())}
            marks = set(m.special.values())
            self.bytes = {}
            for i, s in m.names.items():
                body = s.removesuffix(m.suffix) if m.suffix and i not in marks else s
                end = b" " if body != s else b""
                self.bytes[i] = s.encode("utf-8") if i in marks else bytes(back[c] for c in body) + end
        self.spaced = spaced

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of each step of ids, complete characters only."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids = list(ids)
        for k in range(0, len(ids), self.STEP):
            yield machine.decode(b"".join(map(self.bytes.__getitem__, ids[k : k + self.STEP])))
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(self.pieces(ids))
        return text[1:] if self.spaced else text


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def _decoder(path: str, spaced: bool) -> Decoder:
    return Decoder(path, spaced)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True) -> DataFrame:
    """Rows ``(id, ids array<int>, decoded string)`` for every whole text; no shuffle, one pass.

    ``path`` is a tokenizer file that executors can read.  Null text counts as empty.
    """

    def rows(batches):
        enc, dec = _encoder(path), _decoder(path, spaced)
        for b in batches:
            ids = [enc.encode(t) for t in b["text"]]
            yield {"id": b["id"], "ids": ids, "decoded": [dec.decode(i) for i in ids]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), rows, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def roundtrip_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the ids and of the decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
