"""Ids of distinct strings, worked out once and gathered for every use."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from cohortloom.llm.common import Numbers


class Remembered:
    """Encodes texts cut into parts by encoding every distinct part once.

    ``solve`` takes the new parts and returns a list of ids for each. At most about ``parts`` parts, or eight
    times as many ids, are kept; then all are forgotten and learned anew, which changes no result.
    """

    def __init__(self, solve: Callable[[list[str]], Sequence[Sequence[int]]], parts: int):
        self.solve, self.most = solve, parts
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, split: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text starts (and the last one ends)."""
        if len(self.number) > self.most or len(self.flat) > 8 * self.most:
            self.forget()
        used, new = self.number.of(split)
        if new:
            got = self.solve(new)
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), dtype=np.int32)])
            lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        sizes = np.diff(self.ends)[used]
        upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = self.flat[np.repeat(self.ends[:-1][used] - upto[:-1], sizes) + np.arange(upto[-1])]
        words = np.concatenate([[0], np.cumsum([len(parts) for parts in split])]).astype(np.int64)
        return ids, upto[words]
