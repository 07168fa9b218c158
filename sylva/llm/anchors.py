"""Winnowed anchors of word or byte sequences, and the windows that choose them.

Of the k-grams of each window of ``size`` units the one with the least hash (its
highest ``HASH_BITS`` bits), the last of equals, is the window's anchor. It depends on the
window's content only, not on what is worked on together with it, so equal
windows have equal anchors at equal offsets. The windows of one anchor start at
consecutive places; together they make its block.
"""

from __future__ import annotations

import numpy as np

from .rolling import Sums, byte_values, mixed, word_hashes

#: ASCII white space.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
HASH_BITS = 40
CHUNK = 1 << 14  # places whose anchors are found at once; less than 2 ** (64 - HASH_BITS)


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs (from, to) of consecutive texts of at most ``most`` bytes together, or of one text."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return out + ([(begin, len(sizes))] if begin < len(sizes) else [])


class Bytes:
    """Texts as byte sequences: ``start`` and ``end`` of each text, in bytes of ``data``."""

    def __init__(self, texts: list[bytes]):
        self.end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.start = np.concatenate((np.zeros(1, np.int64), self.end))[: len(texts)]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sums = Sums(byte_values()[self.data])
        self.units = self.data

    def span(self, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end, within their texts, of the parts from ``a`` to ``b``."""
        return a - self.start[text], b - self.start[text]


class Words:
    """Texts as sequences of words: ``start`` and ``end`` of each text, in words; ``first`` and ``last`` byte of each word."""

    def __init__(self, texts: list[bytes]):
        self.at = at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        blank = WHITE[self.data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.first, self.last = edge[::2], edge[1::2]
        bounds = np.searchsorted(self.first, at + 1)
        self.start, self.end = bounds[:-1], bounds[1:]
        self.units = word_hashes(self.data, self.first, self.last)
        self.sums = Sums(self.units)

    def span(self, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end, within their texts, of the parts from word ``a`` to word ``b``."""
        before = self.at[text] + 1
        return self.first[a] - before, self.last[b - 1] - before


def _least(sums: Sums, gram: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all runs of ``wide`` consecutive grams: (first run that has it, its place, its hash)."""
    n = len(sums.sums) - gram
    high = ~np.uint64((1 << 64 - HASH_BITS) - 1)
    later = np.arange(CHUNK + wide, dtype=np.uint64)[::-1]  # of equal hashes the last counts as the least
    buffers = np.empty((2, CHUNK + wide), np.uint64)
    found = []
    for at in range(0, n - wide + 1, CHUNK):
        grams = sums.windows(gram, at, min(n, at + CHUNK + wide - 1))
        size = len(grams)
        low = np.bitwise_and(grams, high, out=buffers[0][:size])
        low |= later[len(later) - size :]
        span, turn = 1, 1
        while span < wide:
            step = min(span, wide - span)
            low = np.minimum(low[:-step], low[step:], out=buffers[turn][: len(low) - step])
            span, turn = span + step, 1 - turn
        head = np.flatnonzero(low[1:] != low[:-1]) + 1
        head = np.concatenate((np.zeros(1, np.int64), head))
        place = size - 1 - (low[head] & ~high).astype(np.int64)
        found.append((head + at, place + at, grams[place]))
    head, place, anchor = (np.concatenate(c) for c in zip(*found))
    new = np.concatenate(([True], place[1:] != place[:-1]))  # a chunk may go on with the last one's anchor
    return head[new], place[new], anchor[new]


def winnow(sequences: Bytes | Words, size: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of all windows, by text and place.

    anchor: the k-gram's hash, mixed; text: number of the text; begin: the block's first unit
    within ``sequences``; windows: number of windows; offset: the anchor's place in the block.
    """
    start, end = sequences.start, sequences.end
    long = end - start >= size
    if not long.any():
        none = np.zeros(0, np.int64)
        return {"anchor": none.view(np.uint64), "text": none, "begin": none, "windows": none, "offset": none}
    head, place, anchor = _least(sequences.sums, gram, size - gram + 1)
    # Runs of windows with one anchor, cut where a text's windows begin and end.
    begin = np.sort(np.concatenate((head, start[long], end[long] - size + 1)))
    begin = begin[np.concatenate(([True], begin[1:] != begin[:-1]))]
    which = np.searchsorted(head, begin, side="right") - 1
    text = np.searchsorted(end, begin, side="right")
    inside = begin + size <= np.append(end, 0)[text]
    windows = np.diff(np.append(begin, begin[-1] + 1))[inside]
    begin, which = begin[inside], which[inside]
    # The least of many hashes are small numbers; mixed anew they are spread over all bits, as a bitmap by the highest ones needs.
    return {"anchor": mixed(anchor[which]), "text": text[inside], "begin": begin, "windows": windows, "offset": place[which] - begin}
