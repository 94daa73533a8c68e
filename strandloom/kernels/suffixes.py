"""Suffix arrays of joined number sequences, and range search in them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class SuffixIndex:
    """Finds every place of a pattern in many sequences; places never cross from one into the next."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        sizes = np.array([len(s) + 1 for s in sequences], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(sequences)), sizes)
        # a closing number of its own for each sequence, below all others, ends every comparison there
        self.text = np.array([x for k, s in enumerate(sequences) for x in (*s, -1 - k)], dtype=np.int64)
        rank = np.unique(self.text, return_inverse=True)[1] if len(self.text) else self.text
        width = 1
        while len(rank) and rank.max() < len(rank) - 1:
            second = np.r_[rank[width:] + 1, np.zeros(min(width, len(rank)), dtype=np.int64)][: len(rank)]
            rank = np.unique(rank * (len(rank) + 1) + second, return_inverse=True)[1]
            width *= 2
        self.order = np.argsort(rank)

    def find(self, pattern: Sequence[int]) -> list[int]:
        """The sequence of each place of ``pattern``, in the order of the suffixes there."""
        low, high = 0, len(self.order)
        for k, x in enumerate(pattern):
            # all suffixes in the range share the pattern so far, so their next numbers ascend
            ahead = np.minimum(self.order[low:high] + k, len(self.text) - 1)
            ahead = self.text[ahead]
            low, high = low + int(np.searchsorted(ahead, x)), low + int(np.searchsorted(ahead, x, "right"))
            if low == high:
                break
        return self.owner[self.order[low:high]].tolist() if len(pattern) else []
