"""Running top-k lists of many queries at once, for tasks that score tiles of rows."""

from __future__ import annotations

import numpy as np


class Nearest:
    """The k best (score, id) of each of n queries so far; free places score -inf. Ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score (queries q, rows): only what reaches a query's k-th score, and its tile's k-th, is merged."""
        wanted = (score >= self.score[q, -1][:, None]) & (score > -np.inf)
        if score.shape[1] > self.k and wanted.sum(axis=1).max(initial=0) > self.k:
            wanted &= score >= -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1, None]
        which, at = np.nonzero(wanted)
        self.merge(q[which], score[which, at], ids[at])

    def merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Single scores: of query q[i] for the row ids[i]."""
        if not len(q):
            return
        own, which = np.unique(q, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(own)), self.k), which])
        s = np.concatenate([self.score[own].ravel(), score])
        i = np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((i, -s, of))
        of = of[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]
        self.score[own], self.id[own] = s[order].reshape(len(own), self.k), i[order].reshape(len(own), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of all that was found."""
        q, place = np.nonzero(self.score > -np.inf)
        return q, self.id[q, place], self.score[q, place]
