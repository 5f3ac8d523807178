"""Similarity of many pairs of short texts at a time, over numpy arrays.

A ratio of matching blocks never exceeds that of the longest common
subsequence, and that never exceeds the ratio of common letters, so both rule
pairs out before blocks are matched.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Pairs whose common subsequences are measured at a time.
STEP = 65_536
ROUNDING = 1e-9


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(letters as small numbers, a row for each text padded with -1; lengths; number of letters)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    known, numbers = np.unique(flat, return_inverse=True)
    out = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = numbers
    return out, sizes, len(known)


def letter_counts(letters: np.ndarray, kinds: int) -> np.ndarray:
    """How often each text has each letter; letters whose numbers are equal modulo 64 count together."""
    width = min(kinds, 64) or 1
    out = np.zeros((len(letters), width), np.int32)
    row, column = np.nonzero(letters >= 0)
    np.add.at(out, (row, letters[row, column] % width), 1)
    return out


def _subsequence(masks: np.ndarray, letters: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of texts ``i`` (64 letters at most) and ``j``, one bit for each letter."""
    state = np.full(len(i), ~np.uint64(0))
    for k in range(int(sizes[j].max(initial=0))):
        at = letters[j, k]
        both = state & np.where(at >= 0, masks[i, at], np.uint64(0))
        state = (state + both) | (state - both)
    inside = np.where(sizes[i] >= 64, ~np.uint64(0), (np.uint64(1) << sizes[i].astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & inside).astype(np.int64)


def _long_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence of two texts of any length."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    whole = (1 << len(a)) - 1
    state = whole
    for c in b:
        both = state & masks.get(c, 0)
        state = ((state + both) | (state - both)) & whole
    return len(a) - state.bit_count()


def ratios_reach(texts: list[str], i: np.ndarray, j: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    """Whether the sequence ratio of each pair of texts (first ``i``, then ``j``) is ``least`` or more."""
    least = np.broadcast_to(np.asarray(least, float), len(i))
    out = np.zeros(len(i), bool)
    if not len(i):
        return out
    letters, sizes, kinds = codes(texts)
    counts = letter_counts(letters, kinds)
    short = sizes <= 64
    masks = np.zeros((len(texts), kinds + 1), np.uint64)
    for k in range(min(64, letters.shape[1])):
        here = np.flatnonzero(short & (letters[:, k] >= 0))
        masks[here, letters[here, k]] |= np.uint64(1 << k)
    for at in range(0, len(i), STEP):
        a, b, bar = i[at : at + STEP], j[at : at + STEP], least[at : at + STEP]
        need = bar * (sizes[a] + sizes[b]) - ROUNDING
        open_ = np.flatnonzero(2 * np.minimum(sizes[a], sizes[b]) >= need)
        open_ = open_[2 * np.minimum(counts[a[open_]], counts[b[open_]]).sum(axis=1) >= need[open_]]
        x, y = a[open_], b[open_]
        swap = ~short[x] & short[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        fits = short[x]
        common = np.zeros(len(open_), np.int64)
        common[fits] = _subsequence(masks, letters, sizes, x[fits], y[fits])
        common[~fits] = [_long_subsequence(texts[p], texts[q]) for p, q in zip(x[~fits], y[~fits])]
        open_ = open_[2 * common >= need[open_]]
        for p in open_:
            one, other = texts[a[p]], texts[b[p]]
            out[at + p] = (1.0 if one == other else SequenceMatcher(None, one, other).ratio()) >= bar[p]
    return out


def jaccards_reach(texts: list[str], i: np.ndarray, j: np.ndarray, least: np.ndarray | float, n: int = 3) -> np.ndarray:
    """Whether the Jaccard similarity of the ``n``-gram sets of each pair of texts is ``least`` or more; texts without n-grams have none."""
    grams = [char_grams(t, n) for t in texts]
    sizes = np.array([len(g) for g in grams], np.int64)
    least = np.broadcast_to(np.asarray(least, float), len(i))
    out = np.zeros(len(i), bool)
    open_ = (sizes[i] > 0) & (sizes[j] > 0) & (np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]) - ROUNDING)
    for p in np.flatnonzero(open_):
        both = len(grams[i[p]] & grams[j[p]])
        out[p] = both / (sizes[i[p]] + sizes[j[p]] - both) >= least[p]
    return out


def shared(left: list[set], right: list[set]) -> np.ndarray:
    """How many members each two sets of two lists have in common, as a matrix."""
    numbers: dict = {}
    for s in left:
        for x in s:
            numbers.setdefault(x, len(numbers))
    out = np.zeros((len(left), len(right)), np.int64)
    step = 4096
    rows = [np.fromiter((numbers[x] for x in s), np.int64, len(s)) for s in left]
    columns = [np.fromiter((numbers[x] for x in s if x in numbers), np.int64) for s in right]
    for low in range(0, len(numbers), step):
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        for m, lists in ((a, rows), (b, columns)):
            for k, own in enumerate(lists):
                m[k, own[(own >= low) & (own < low + step)] - low] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def char_grams(text: str, n: int = 3) -> set[str]:
    return {text[k : k + n] for k in range(len(text) - n + 1)}
