"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; the rest is cut into pieces of at most ``piece``
ids.  The pieces of a group of documents are dealt to ``k`` windows: each piece starts as a partial
partition of its own; the two partitions of greatest imbalance are merged again and again, the fullest
windows of one onto the emptiest of the other, until one partition with near-equal windows is left.
``k`` starts at the least count that could do and rises whenever a window would exceed the capacity.

Groups are formed while a partition streams by, about ``GROUP`` windows each, so nothing is shuffled and a
task holds one group.  A sequence's id is the number of its partition and of the window in it.

Defined results: a null or empty text is the end id alone; documents of any length are cut; repeated rows
and rows with equal ids are packed as often as they occur; pieces of equal length are dealt in order of
arrival; columns besides id and text are left out, so that their names can't clash; an empty table gives no
pieces.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.byte_tokens import byte_tokenizer
from quiverlake.llm.common import map_rows, text_of

WINDOW = 2048
END_ID = 1
#: Windows of a group, and the longest piece of a document's rest.
GROUP = 256
PIECE = 512


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal the sizes to at most ``k`` windows; returns the numbers of the sizes in each window."""
    heap = [(-s, n, np.array([s]), [[n]]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            total, held = np.concatenate([a, b]), in_a + in_b
        else:  # fullest onto emptiest
            total = np.zeros(k, np.int64)
            total[: len(a)] = a
            total[k - len(b) :] += b[::-1]
            held = in_a + [[] for _ in range(k - len(a))]
            for at, more in enumerate(reversed(in_b), k - len(b)):
                held[at] = held[at] + more
        down = np.argsort(-total, kind="stable")
        total, held = total[down], [held[i] for i in down.tolist()]
        spread = total[0] - (total[-1] if len(total) == k else 0)
        heapq.heappush(heap, (-int(spread), order, total, held))
        order += 1
    return [h for h in heap[0][3] if h] if heap else []


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within the capacity; their count rises until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += max(1, k // 256)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, start, tokens binary, doc_tokens, sequence_id, offset)``, one for each piece.

    ``tokens`` holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "tokens", "doc_tokens", "sequence_id", "offset"]

    def rows(batches):
        encoder = byte_tokenizer(path)
        base, count = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []  # (id, start, ids, ids of the document)
        held_ids = 0

        def place(pieces: list[list[tuple]]) -> dict:
            nonlocal count
            out = {n: [] for n in names}
            for window_pieces in pieces:
                at = 0
                for doc, start, ids, whole in window_pieces:
                    for n, v in zip(names, (doc, start, ids.tobytes(), whole, base + count, at)):
                        out[n].append(v)
                    at += len(ids)
                count += 1
            return out

        for b in batches:
            full = []
            for doc, text in zip(b["id"], b["text"]):
                ids = encoder.encode(text)
                ids.append(end_id)
                whole, cut = len(ids), len(ids) // window * window
                full += [[(doc, k, ids[k : k + window], whole)] for k in range(0, cut, window)]
                for k in range(cut, whole, piece):
                    held.append((doc, k, ids[k : k + piece], whole))
                held_ids += whole - cut
                if held_ids >= GROUP * window:
                    full += [[held[i] for i in w] for w in deal([len(h[2]) for h in held], window)]
                    held, held_ids = [], 0
            yield place(full)
        yield place([[held[i] for i in w] for w in deal([len(h[2]) for h in held], window)])

    out = map_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), rows, f"id {kind}, start long, tokens binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)



def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with their length and checksum in place of the ids."""
    return pieces.select("doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("length"), F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
