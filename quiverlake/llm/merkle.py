"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

Blank lines part sections, line ends part paragraphs, and a paragraph is cut into phrases at places that
its own bytes decide, so that an edit moves no cut far from it.  A phrase is hashed, a paragraph hashes the
hashes of its phrases, a section those of its paragraphs, the root those of its sections.

The fingerprint is the tree: the root (32 hex digits) and the bytes of all phrases; then, for each section,
``:`` and its node, and for each paragraph ``.``, its node and its phrases.  A node is eight signs of base64
(48 bits of its hash), a phrase too (41 bits of its hash and 7 of its length, which is below 128 bytes).
Equal roots mean equal texts.  Two trees are walked down from the root, and only where nodes differ, which
locates the edits and their share of the text.

Defined results: null text counts as empty; an empty text has a tree with one empty paragraph, and two
empty texts are alike (1.0); a document alone is its own successor; rows with equal ids follow each other
in order of text, so that repeated rows are each other's successors; null ids come first; ids are numbers or
texts; other columns are left out, so that their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64decode, b64encode
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import map_rows, text_of
from quiverlake.llm.ranges import IdRanges, range_parts

#: A phrase ends after a space that follows one of these signs, or at 96 bytes.
_PHRASE = re.compile(rb"[^\n]{1,95}?[dhtx.,;:!?] |[^\n]{1,96}")
_ROOT = 32
_NODE = 8
_LENGTH_BITS = 7
_LENGTH = np.uint64((1 << _LENGTH_BITS) - 1)


def _signs(hashes: np.ndarray) -> str:
    """48-bit numbers as eight signs each."""
    return b64encode(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def _numbers(signs: str) -> np.ndarray:
    wide = np.zeros((len(signs) // _NODE, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(b64decode(signs), np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel()


def fingerprint(text: str) -> str:
    """The tree of a whole text."""
    sections = [s.split(b"\n") for s in text.encode("utf-8", "surrogatepass").split(b"\n\n")]
    paragraphs = [_PHRASE.findall(p) for s in sections for p in s]
    phrases = [x for p in paragraphs for x in p]
    lengths = np.fromiter(map(len, phrases), np.uint64, len(phrases))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
    leaves = _signs((hashes >> np.uint64(23) << np.uint64(_LENGTH_BITS)) | lengths)
    below, at = hashes.tobytes(), 0
    nodes = []
    for p in paragraphs:
        nodes.append(xxhash.xxh3_64_intdigest(below[8 * at : 8 * (at + len(p))], 1))
        at += len(p)
    inner, firsts = np.array(nodes, np.uint64), np.cumsum([0, *map(len, sections)]).tolist()
    tops = np.array([xxhash.xxh3_64_intdigest(inner[a:b].tobytes(), 2) for a, b in zip(firsts, firsts[1:])], np.uint64)
    root = hashlib.blake2b(tops.tobytes(), digest_size=_ROOT // 2).hexdigest()
    own, of_section = _signs(inner >> np.uint64(16)), _signs(tops >> np.uint64(16))
    out, at, k = [root, str(int(lengths.sum()))], 0, 0
    for n, s in enumerate(sections):
        parts = [":" + of_section[_NODE * n : _NODE * (n + 1)]]
        for _ in s:
            end = at + len(paragraphs[k])
            parts.append("." + own[_NODE * k : _NODE * (k + 1)] + leaves[_NODE * at : _NODE * end])
            at, k = end, k + 1
        out.append("".join(parts))
    return out[0] + "".join(out[1:])


def _split(tree: str) -> tuple[int, list[str]]:
    """Bytes of all phrases, and the sections: node and paragraphs."""
    size, *sections = tree[_ROOT:].split(":")
    return int(size), sections


def _left(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Branches of either side whose node the other lacks, counting repeats; only nodes are compared."""
    x, y = Counter(t[:_NODE] for t in a), Counter(t[:_NODE] for t in b)
    return _without(a, y), _without(b, x)


def _without(branches: list[str], have: Counter) -> list[str]:
    have, out = have.copy(), []
    for t in branches:
        if have[t[:_NODE]] > 0:
            have[t[:_NODE]] -= 1
        else:
            out.append(t)
    return out


def _below(sections: list[str]) -> list[str]:
    return [p for s in sections for p in s[_NODE + 1 :].split(".")]


def _phrases(paragraphs: list[str]) -> np.ndarray:
    return _numbers("".join([p[_NODE:] for p in paragraphs]))


def likeness(a: str, b: str) -> float:
    """Share of the two texts, by the bytes of phrases, that lies in equal branches."""
    if a[:_ROOT] == b[:_ROOT]:
        return 1.0
    (na, sa), (nb, sb) = _split(a), _split(b)
    if not na + nb:
        return 0.0
    ra, rb = _left(sa, sb)
    ra, rb = _left(_below(ra), _below(rb))
    xa, xb = _phrases(ra), _phrases(rb)
    (ua, ca), (ub, cb) = np.unique(xa, return_counts=True), np.unique(xb, return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = int((np.minimum(ca[ia], cb[ib]) * (both & _LENGTH).astype(np.int64)).sum())
    left = int((xa & _LENGTH).sum()) + int((xb & _LENGTH).sum()) - 2 * shared
    return 1 - left / (na + nb)


def edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """Places (section, paragraph, phrase) of ``b`` that ``a`` lacks; branches with equal nodes aren't entered.

    A paragraph that differs in the order of its phrases alone has no such place.
    """
    if a[:_ROOT] == b[:_ROOT]:
        return []
    sa, sb = _split(a)[1], _split(b)[1]
    left, _ = _left(sa, sb)
    have_s, have_p = Counter(s[:_NODE] for s in sa), Counter(p[:_NODE] for p in _below(left))
    have_x = Counter(_phrases(_without(_below(left), Counter(p[:_NODE] for p in _below(_without(sb, have_s))))).tolist())
    found = []
    for i, s in enumerate(sb):
        if have_s[s[:_NODE]] > 0:
            have_s[s[:_NODE]] -= 1
            continue
        for j, p in enumerate(s[_NODE + 1 :].split(".")):
            if have_p[p[:_NODE]] > 0:
                have_p[p[:_NODE]] -= 1
                continue
            for k, x in enumerate(_numbers(p[_NODE:]).tolist()):
                if have_x[x] > 0:
                    have_x[x] -= 1
                else:
                    found.append((i, j, k))
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, fingerprint)``; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        for b in batches:
            yield {"id": b["id"], "fingerprint": [fingerprint(t) for t in b["text"]]}

    return map_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), rows, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def compare_with_successor(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, an edited form of it, and the document after it by ascending id.

    Ids alone are sampled for range bounds, which are ids of the table; texts then move once, to the
    range of their id, and the row at a bound is sent to the range before it too.  Each range streams in
    order, holding two documents.
    """
    rows_in = docs.select("doc_id", text_of().alias("text"))
    parts = range_parts(docs)
    ranges = IdRanges.of(rows_in, "doc_id", parts)
    where = ranges.part("doc_id")
    target = lambda to, ahead: F.struct(to.cast("int").alias("part"), F.lit(ahead).alias("ahead"))
    sent = F.array_compact(F.array(
        target(where, 0),
        F.when(ranges.at_bound("doc_id", where), target(where - 1, 1)),
        F.when(ranges.is_first("doc_id"), target(F.lit(len(ranges.bounds)), 1)),
    ))
    placed = (
        rows_in.select("doc_id", "text", F.explode(sent).alias("t")).select("t.part", "t.ahead", "doc_id", "text")
        .repartition(parts // 4, "part")
        .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches):
        held = None
        for b in batches:
            out = {n: [] for n in names}
            for part, ahead, doc_id, text in zip(b["part"], b["ahead"], b["doc_id"], b["text"]):
                mark = fingerprint(text)
                if held and held[0] == part and not held[1]:
                    _, _, own, before, tree = held
                    k = len(before) // 4
                    edited = before[: len(before) - k] + text[:k]
                    other = fingerprint(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    for n, v in zip(names, (own, len(before), digest, tree, other, likeness(tree, other), likeness(tree, mark))):
                        out[n].append(v)
                held = (part, ahead, doc_id, text, mark)
            yield out

    return map_rows(placed, rows, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
