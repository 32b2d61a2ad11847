"""Ids of the word-level vocabulary for many texts at once: each distinct word of a step is encoded once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from panelwright.llm.common import is_plain, merges, reference_tokenizer, span_hashes

#: The vocabulary's contractions, split off before anything else.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Words a worker remembers before it starts anew.
REMEMBERED = 120_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point below 65,536; texts with others go to the library."""
    kinds = np.full(1 << 16, OTHER, np.uint8)
    for point in range(1 << 16):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            kinds[point] = LETTER
        elif kind == "N":
            kinds[point] = NUMBER
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


def word_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of letters, single numbers, runs of other signs, contractions."""
    kind = classes()[points]
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)) + 1
    starts = np.concatenate(([0], edge))
    ends = np.concatenate((edge, [len(points)]))
    lone = np.flatnonzero((points[starts] == 39) & (ends - starts == 1) & (kind[starts] == OTHER))
    lone = lone[(lone + 1 < len(starts))]
    lone = lone[kind[starts[lone + 1]] == LETTER]
    if len(lone):
        moved = []
        for k in lone:
            head = "".join(map(chr, points[starts[k + 1] : min(starts[k + 1] + 2, ends[k + 1])]))
            size = next((len(c) for c in CONTRACTIONS if head.startswith(c)), 0)
            if size:
                moved.append((k, starts[k + 1] + size))
        for k, to in moved:
            ends[k], starts[k + 1] = to, to
    keep = (kind[starts] != SPACE) & (ends > starts)
    return starts[keep], ends[keep]


class WordEncoder:
    """Encodes lists of texts with the word vocabulary at ``path``; remembers a bounded number of words."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        self.engine = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=merges(path)[0], special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.rank: dict[int, int] = {}
        self.flat = np.empty(1 << 16, np.uint16)
        self.used = 0
        self.sizes = np.empty(1 << 14, np.int32)
        self.begins = np.empty(1 << 14, np.int64)

    def _learn(self, hashes: list[int], found: list[str]) -> None:
        if len(self.rank) + len(hashes) > REMEMBERED:
            self.forget()
        encode = self.engine._encode_single_piece  # the engine's merges of one word
        for key, word in zip(hashes, found):
            ids = encode(word.encode() + b"\xff")
            at = len(self.rank)
            if at == len(self.sizes):
                self.sizes, self.begins = np.resize(self.sizes, 2 * at), np.resize(self.begins, 2 * at)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.begins[at], self.sizes[at] = self.used, len(ids)
            self.used += len(ids)
            self.rank[key] = at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as uint32."""
        plain = [is_plain(t, self.path) for t in texts]
        out: list = [None] * len(texts)
        lowered = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() if p else "" for t, p in zip(texts, plain)]
        for k, whole in enumerate(plain):
            if not whole:
                out[k] = np.array(reference_tokenizer(self.path).encode(texts[k], add_special_tokens=False).ids, np.uint32)
        joined = "\n" + "\n".join(lowered) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = word_bounds(points)
        hashes = span_hashes(points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019), starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.rank) + len(keys) > REMEMBERED:
            self.forget()
        rank = self.rank
        new = [k for k, key in enumerate(keys) if key not in rank]
        if new:
            at = first[new]
            self._learn([keys[k] for k in new], [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        place = np.fromiter((self.rank[key] for key in keys), np.int64, len(keys))[inverse] if keys else np.empty(0, np.int64)
        sizes = self.sizes[place].astype(np.int64)
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(self.begins[place] - (stops - sizes), sizes) + np.arange(total)].astype(np.uint32)
        begins = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in lowered)]))
        cuts = np.concatenate(([0], stops))[begins]
        for k, whole in enumerate(plain):
            if whole:
                out[k] = ids[cuts[k] : cuts[k + 1]]
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
