"""Word shingles of whole texts as 64-bit hashes, by numpy over blocks of UTF-8 text."""

from __future__ import annotations

import numpy as np

from spantide.llm.tokens import mix64, span_hashes

WORDS = 5
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count) of the distinct shingles, sorted by text and hash.

    A text of fewer words than a shingle has one shingle, all its words; a text without
    words has none.
    """
    data = b"\n".join(texts)
    empty = np.zeros(0, np.int64)
    if not data:
        return empty, np.zeros(0, np.uint64), empty
    buf = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(buf)
    if not len(starts):
        return empty, np.zeros(0, np.uint64), empty
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    of = np.searchsorted(begin, starts, side="right") - 1
    h, n = span_hashes(buf, starts, ends), len(starts)
    acc, reach = mix64(h), np.zeros(n, np.int64)
    for k in range(1, words):
        m = max(n - k, 0)        # fewer words than k in the whole block: none has a k-th next
        same = np.zeros(n, bool)
        same[:m] = of[k:] == of[:m]
        nxt = np.zeros(n, np.uint64)
        nxt[:m] = h[k:]
        acc = mix64(acc * _STEP + np.where(same, nxt, np.uint64(0)))
        reach += same
    first = np.diff(of, prepend=-1) != 0
    use = np.flatnonzero((reach == words - 1) | first)
    of, acc = of[use], acc[use]
    order = np.lexsort((acc, of))
    of, acc = of[order], acc[order]
    new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(acc, prepend=~acc[:1]) != 0))
    return of[new], acc[new], np.diff(np.append(new, len(of)))
