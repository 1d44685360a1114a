"""Best segmentations of all distinct words of a batch at once, in numpy.

Helper of ``sentence_pieces``: the same max-plus recurrence, run over the end position of many words side by side. Pieces are
found by 64-bit hashes of substrings.
"""

from __future__ import annotations

import numpy as np

from flowspark.llm import tokens as T

#: Longer words are left to the caller.
LONGEST = 48
_R = np.uint64(0xD1342543DE82EF95)
_POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full(LONGEST, _R)), dtype=np.uint64)
_SLOTS = 20


def _mixed(points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix64(points.astype(np.uint64) + np.uint64(1))


class PieceTable:
    """Exact look-up of substring hashes: a slot table, and the next one for pieces whose slot is taken."""

    def __init__(self, surfaces: list[str]):
        keys = np.zeros(len(surfaces), np.uint64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(surfaces):
                h = np.uint64(0)
                for c in _mixed(np.array([ord(x) for x in s])):
                    h = h * _R + c
                keys[i] = h
        self.keys = np.append(keys, 0)
        self.tables = []
        left, shift = np.arange(len(keys)), 64 - _SLOTS
        while len(left) and shift >= 0:
            table = np.full(1 << _SLOTS, len(keys), np.int32)
            slot = ((keys[left] >> np.uint64(shift)) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)
            table[slot] = left
            self.tables.append((np.uint64(shift), table))
            left = left[table[slot] != left]
            shift -= _SLOTS
        if len(left):
            raise ValueError("two pieces have the same hash")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, the number of pieces where there is none."""
        out = np.full(len(h), len(self.keys) - 1, np.int32)
        for shift, table in self.tables:
            got = table[((h >> shift) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)]
            same = self.keys[got] == h
            out[same] = got[same]
        return out


def solve(table: PieceTable, scores: np.ndarray, unknown: float, longest: int, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first character, word) of the best segmentation of every word, in order; -1 is a character without a piece.

    Of equal scores the one whose last piece is longest wins, at every place. ``scores`` has one more entry, minus infinity.
    """
    order = np.argsort(sizes, kind="stable")[::-1]  # longest words first: the words that reach a place are a prefix
    n, width = len(order), int(sizes.max(initial=0))
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0
    piece = np.full((width + 1, n), -1, np.int32)
    step = np.ones((width + 1, n), np.int8)
    run = np.zeros((width + 1, n), np.uint64)
    first, size = starts[order], sizes[order]
    with np.errstate(over="ignore"):
        for b in range(1, width + 1):
            m = int(np.searchsorted(-size, -b, side="right"))
            run[b, :m] = run[b - 1, :m] * _R + _mixed(points[first[:m] + b - 1])
            for length in range(min(b, longest), 0, -1):
                found = table.find(run[b, :m] - run[b - length, :m] * _POWERS[length])
                value = best[b - length, :m] + scores[found]
                if length == 1:
                    none = found == len(scores) - 1
                    value = np.where(none, best[b - 1, :m] + unknown, value)
                    found = np.where(none, -1, found)
                better = np.flatnonzero(value > best[b, :m])
                best[b, better], piece[b, better], step[b, better] = value[better], found[better], length
    words, places, pieces = [], [], []
    live, at = np.arange(n), size.astype(np.int64).copy()
    while len(live):
        here = at[live]
        back = step[here, live]
        pieces.append(piece[here, live])
        at[live] = here - back
        places.append(at[live].copy())
        words.append(order[live])
        live = live[at[live] > 0]
    if not words:
        none = np.zeros(0, np.int64)
        return none, none, none
    words, places, pieces = np.concatenate(words), np.concatenate(places), np.concatenate(pieces)
    by = np.lexsort((places, words))
    return pieces[by], places[by] + starts[words[by]], words[by]


def segment_starts(points: np.ndarray, offsets: np.ndarray, space: int, alone: tuple[int, ...]) -> np.ndarray:
    """Places that every path passes: text starts, spaces after other characters, and both sides of characters in no piece."""
    cut = np.zeros(len(points) + 1, bool)
    cut[offsets] = True
    gap = points == space
    cut[1:-1] |= gap[1:] & ~gap[:-1]
    single = np.isin(points, np.array(alone, points.dtype)) if alone else np.zeros(len(points), bool)
    cut[:-1] |= single
    cut[1:] |= single
    return np.flatnonzero(cut[:-1])


def word_hashes(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of every word of up to LONGEST characters; of longer ones only the start counts, the caller sets them apart."""
    with np.errstate(over="ignore"):
        place = np.minimum(np.arange(len(points)) - np.repeat(starts, sizes), LONGEST)
        total = np.add.reduceat(_mixed(points) * _POWERS[place], starts)
        return T.mix64(total + sizes.astype(np.uint64))
