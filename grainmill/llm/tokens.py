"""Token ids of whole texts, one encoding for each distinct word.

Only for tokenizers whose pieces never cross white space, as those with word ends: then the ids of a text are the
ids of its words in a row. A worker keeps what it has encoded, up to `CACHE_WORDS` words; of a full cache, the half
stays that most slices used lately.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from grainmill.llm.text import Slice, Words

CACHE_WORDS = 1 << 20
ENCODE_WORDS = 4096
_CACHES: dict[str, "WordCache"] = {}


class WordCache:
    """Sorted word hashes with the ids of each word in one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        small = max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16
        self.hashes = np.zeros(0, np.uint64)
        self.begins, self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16 if small else np.uint32), 0

    def shrink(self) -> None:
        """Forget all but the CACHE_WORDS // 2 words that most slices used; older uses count half."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:CACHE_WORDS // 2])
        self.ids = self.spread(keep)
        self.hashes, self.sizes, self.uses = self.hashes[keep], self.sizes[keep], self.uses[keep] // 2
        self.used = len(self.ids)
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def spread(self, at: np.ndarray) -> np.ndarray:
        """Ids of the words at these places, one after the other."""
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.begins[at] - (ends - sizes), sizes) + np.arange(total)]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        parts = []
        for begin in range(0, len(words), ENCODE_WORDS):  # an encoding is far larger than its ids
            found = self.encode(words[begin:begin + ENCODE_WORDS])
            count = np.fromiter(map(len, found), np.int32, len(found))
            parts.append((count, np.fromiter(chain.from_iterable(found), self.ids.dtype, int(count.sum()))))
        sizes, flat = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[:self.used], np.zeros(max(self.used // 2, len(flat)) + 1024, self.ids.dtype)))
        self.ids[self.used:self.used + len(flat)] = flat
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begins = np.insert(self.begins, at, self.used + np.concatenate(([0], np.cumsum(sizes)))[:-1])
        self.sizes = np.insert(self.sizes, at, sizes)
        self.uses = np.insert(self.uses, at, np.zeros(len(at), np.int32))
        self.used += len(flat)

    def rows(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and each row's first place in it."""
        words = Words(part.data, part.offsets)
        hashes = words.hashes(part.data)
        order = np.argsort(hashes)
        ordered = hashes[order]
        head = np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]
        distinct, where = ordered[head], order[head]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(head) - 1
        if len(self.hashes) + len(distinct) > CACHE_WORDS:
            self.shrink()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        self.uses[at[known]] += 1
        if not known.all():
            raw = part.data.tobytes()
            new = where[~known]
            self.add(distinct[~known], [raw[a:b].decode("utf-8") for a, b in
                                        zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        places = at[inverse]
        ends = np.cumsum(self.sizes[places], dtype=np.int64)
        return self.spread(places), np.concatenate(([0], ends))[words.first]


def cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]
