"""Where the keys with very many rows go, so that no partition of a join gets much more than its share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Layout:
    """parts: for each tracked key, the most frequent first, the partitions that its rows are dealt to.

    The first `hot` keys go to every partition. Partitions below `designated` hold tracked
    keys, the `rest` after them the others, by hash. most: rows that the largest is expected to get.
    """

    parts: tuple[tuple[int, ...], ...]
    hot: int
    designated: int
    rest: int
    most: float

    @property
    def partitions(self) -> int:
        return self.designated + self.rest

    def __str__(self) -> str:
        dealt = f"{self.hot} hot keys in every partition, " if self.hot else ""
        return f"{dealt}{len(self.parts) - self.hot} tracked keys in {self.designated} partitions, the others hashed to {self.rest}"


def cut(loads: np.ndarray, most: float, limit: int) -> list[int]:
    """Where runs of consecutive loads begin if each takes in as many as stay within `most`: the fewest runs. Empty if more than `limit` are needed."""
    so_far = np.concatenate(([0.0], np.cumsum(loads)))
    cuts, at = [], 0
    while at < len(loads):
        if len(cuts) == limit:
            return []
        cuts.append(at)
        at = max(at + 1, int(np.searchsorted(so_far, so_far[at] + most * (1 + 1e-12), "right")) - 1)
    return cuts


def plan(m: np.ndarray, r_rows: int, s_rows: int, partitions: int, hybrid: bool = True) -> Layout:
    """The layout whose largest partition is smallest, for keys of R whose rows of S are m, largest first.

    A key with more rows than a partition's share is hot: hybrid deals its rows to all
    partitions, each of which has its row of R at hand; otherwise they are dealt to as
    many as they fill. The other tracked keys are cut into runs, those that aren't tracked are hashed. How
    many partitions each kind gets, and where the cuts are, follows from the least load that suffices.
    """
    n, total = partitions, float(r_rows + s_rows)
    share = total / n
    hot = int((m > share).sum()) if hybrid and n > 1 else 0
    pieces = np.minimum(n, np.maximum(1, np.ceil(m[hot:] / share))).astype(int)
    loads = np.repeat(m[hot:] / pieces + 1, pieces)
    others = max(0.0, s_rows - m.sum()) + max(0, r_rows - len(m))
    if not len(loads) or n < 2:
        return Layout((tuple(range(n)),) * hot + ((0,),) * (len(m) - hot), hot, 0, n, share)
    low, high = max(loads.max(), (loads.sum() + others) / n), loads.sum() + others + 1
    fits = lambda most: bool(cut(loads, most, n - max(1, int(np.ceil(others / most - 1e-9)))))
    if not fits(low):
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        low = high
    cuts = cut(loads, low, n - 1)
    of = np.searchsorted(cuts, np.arange(len(loads)), "right") - 1
    ends = np.cumsum(pieces)
    parts = tuple(tuple(of[end - size : end].tolist()) for end, size in zip(ends.tolist(), pieces.tolist(), strict=True))
    return Layout((tuple(range(n)),) * hot + parts, hot, len(cuts), n - len(cuts), low + m[:hot].sum() / n)
