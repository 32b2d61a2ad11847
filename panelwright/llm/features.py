"""Hashed byte n-grams and page shape figures of whole texts, and the small linear models trained on them."""

from __future__ import annotations

import numpy as np

from panelwright.llm.common import _LOWER, _SPACE, words


def ngram_matrix(texts: list[bytes], size: int, lower: bool) -> np.ndarray:
    """Unit-length rows of square roots of hashed counts of all 1-, 2- and 3-byte sequences, white space read as one sign."""
    raw = np.frombuffer(b" " + b"  ".join(texts) + b"  ", np.uint8)
    data = np.where(_SPACE[raw], np.uint8(32), _LOWER[raw] if lower else raw).astype(np.uint32)
    lengths = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * size, lengths)
    n = len(owner)
    one = data[:n] * np.uint32(0x9E3779B1)
    two = (one ^ (data[1:] * np.uint32(0x85EBCA77))[:n]) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (data[2:] * np.uint32(0x27D4EB2F))[: n - 1]) * np.uint32(0x165667B1)
    shift = np.uint32(32 - int(size).bit_length() + 1)
    counts = np.zeros(len(texts) * size)
    for grams in (one, two, three):
        counts += np.bincount(owner[: len(grams)] + (grams >> shift), minlength=len(counts))
    rows = np.sqrt(counts.reshape(len(texts), size), dtype=np.float32)
    return rows / np.maximum(1e-6, np.sqrt((rows * rows).sum(1)))[:, None]


def _shares(flags: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(flags, 0), begins) / np.maximum(1, lengths)


def word_figures(texts: list[bytes]) -> np.ndarray:
    """Per text: share of distinct words, share of words that repeat the one before, share of the commonest word, log of words."""
    hashes, begins = words(texts)
    out = np.zeros((len(texts), 4))
    for k, (a, b) in enumerate(zip(begins, begins[1:])):
        own = hashes[a:b]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            out[k] = (len(counts) / len(own), (own[1:] == own[:-1]).mean() if len(own) > 1 else 0, counts.max() / len(own), np.log1p(len(own)))
    return out


def shape_figures(texts: list[bytes]) -> np.ndarray:
    """Per text: shares of capitals, digits, signs, bars and white space, lines, mean line, share of short lines."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum([0, *(lengths[:-1] + 1)]) if len(texts) else np.empty(0, np.int64)
    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    white = _SPACE[raw]
    sign = ~(letter | digit | white)
    columns = [_shares(f.astype(np.int64), begins, lengths) for f in (upper, digit, sign, raw == 124, white)]
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    short = np.array([sum(len(line) < 40 for line in t.split(b"\n")) for t in texts])
    return np.column_stack([*columns, np.log1p(lines), np.log1p(lengths / np.maximum(1, lines)), short / np.maximum(1, lines)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(rows: np.ndarray, targets: np.ndarray, weights: np.ndarray, penalty: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Weighted logistic regressions (one per column of ``targets``) by accelerated gradient steps; the last row is the constant."""
    x = np.column_stack([rows, np.ones(len(rows), np.float32)]).astype(np.float32, copy=False)
    lengths = np.concatenate([(part * part).sum(1) for part in np.array_split(x, 16)])
    share = (weights / weights.sum()).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], targets.shape[1]), np.float32)
    ahead, momentum = w.copy(), 1.0
    rate = 4.0 / max(1e-9, float((share[:, 0] * lengths).sum()))
    hold = np.full((x.shape[1], 1), penalty, np.float32)
    hold[-1] = 0
    for _ in range(rounds):
        slope = x.T @ (share * (sigmoid(x @ ahead) - targets)) + hold * ahead
        new = ahead - rate * slope
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / grown * (new - w)
        w, momentum = new, grown
    return w


def scores(rows: np.ndarray, model: np.ndarray) -> np.ndarray:
    return rows @ model[:-1] + model[-1]
