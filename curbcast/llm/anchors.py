"""Content-defined anchors: places at which equal stretches of two texts must meet.

Every ``window`` bytes of a text select the ``gram`` of ``gram`` bytes with the
least hash (the leftmost of equals).  Two equal windows select the same gram at
the same offset, wherever they stand.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import U64, mix64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U64))
_PLACE_BITS = 20
PIECE = (1 << _PLACE_BITS) - 4096      # bytes worked on at a time


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U64), np.full(n, _INVERSE, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefix:
    """Hashes of any stretch of a byte array, from running sums."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(12, int(raw.size).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(raw.size + 1, U64)
        np.cumsum(_BYTE[raw] * up[:raw.size], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = self.sums.size - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours: running minima of blocks from both sides."""
    n = values.size
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(raw: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of a text.

    ``place``: the gram's start; ``first`` and ``last``: starts of the first and
    the last window that select it; ``gram``: hash of the gram; ``segment``: hash of
    everything those windows cover, and of the gram's offset in it.
    """
    found: dict[str, list] = {k: [] for k in ("place", "first", "last", "gram", "segment")}
    for at in range(0, max(raw.size - window + 1, 0), PIECE):
        piece = raw[at:at + PIECE + window - 1]
        prefix = Prefix(piece)
        hashes = prefix.grams(gram)
        places = np.arange(hashes.size, dtype=U64)
        chosen = sliding_min((hashes >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | places, window - gram + 1) & U64((1 << _PLACE_BITS) - 1)
        chosen = chosen.astype(np.int64)
        cuts = np.flatnonzero(np.diff(chosen)) + 1
        first = np.concatenate(([0], cuts))
        last = np.concatenate((cuts, [chosen.size])) - 1
        place = chosen[first]
        found["place"].append(place + at)
        found["first"].append(first + at)
        found["last"].append(last + at)
        found["gram"].append(hashes[place])
        found["segment"].append(mix64(prefix.of(first, last + window) + (place - first).astype(U64)))
    return {k: np.concatenate(v) if v else np.empty(0, U64 if k in ("gram", "segment") else np.int64) for k, v in found.items()}
