"""Ids of a byte-level BPE tokenizer file, one whole text at a time."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

from quiverlake.llm.bpe import byte_alphabet

#: Word rule of byte-level vocabularies (fixed value), spelled so that no run is tried twice.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s++$|\s+(?!\S)|\s"
#: The same rule where no two signs of white space meet: without looking ahead, which is faster.
_PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s"
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS_MEET = re.compile(_BLANK + _BLANK).search
#: Texts with a longer unbroken run go to the library that merges long runs by a heap.
_LONG_RUN = 2000


def _may_run_long(text: str) -> bool:
    """Whether a run without blanks, or of white space alone, can have ``_LONG_RUN`` signs: such a run fills a
    half of that length, counted from the start of the text."""
    half = _LONG_RUN // 2
    return any(" " not in (part := text[k : k + half]) or part.isspace() for k in range(0, len(text) - half + 1, half))


class ByteTokenizer:
    """Same ids as the tokenizers library gives for the file, special strings included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.greatest_id = max(*ranks.values(), *self.special.values(), 0)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=_PLAIN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def encode(self, text: str) -> array:
        if len(text) > _LONG_RUN and _may_run_long(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids)
        if "<|" not in text:
            return array("I", (self.fast if _BLANKS_MEET(text) else self.plain).encode_ordinary(text))
        out = array("I")
        for part in self.marks.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(self.fast.encode_ordinary(part))
        return out


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)
