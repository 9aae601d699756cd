"""Words of texts as NumPy arrays.

A word is a run of characters other than the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``). Texts are joined into blocks of bounded size and whole blocks
are hashed at once; a longer text forms a block of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
# Words are hashed in pieces of this size, whatever the length of a text or word.
PIECE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

# Odd, so it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def blocks(texts: pa.Array | list, lower: bool = False) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last, texts as bytes) of runs of about BLOCK_BYTES; NULL counts as empty.
    ``lower`` changes A-Z only. Only one run at a time becomes Python objects."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    column = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, before + BLOCK_BYTES)) + 1, len(column))
        run = column.slice(first, last - first).to_pylist()
        yield first, last, [(x or b"").lower() if lower else x or b"" for x in run]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, for one piece of a block."""
    up = np.full(PIECE_BYTES, _BASE, np.uint64)
    down = np.full(PIECE_BYTES, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclass(frozen=True)
class Words:
    """All words of a block of texts, in order."""

    data: np.ndarray  # bytes of the block, texts separated by a space
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    edges: np.ndarray  # bytes of text i are edges[i]:edges[i + 1] - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same in any block."""
        up, down = _powers()
        out = np.zeros(len(self.starts), np.uint64)
        for at in range(0, len(self.data), PIECE_BYTES):
            piece = self.data[at : at + PIECE_BYTES]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
            first, last = np.searchsorted(self.starts, (at, at + len(piece)))
            if first and self.ends[first - 1] > at:
                # A word that began in an earlier piece goes on in this one.
                end = min(int(self.ends[first - 1]) - at, len(piece))
                shift = pow(_BASE, at - int(self.starts[first - 1]), 1 << 64)
                out[first - 1 : first] += total[end : end + 1] * np.uint64(shift)
            starts = self.starts[first:last] - at
            ends = np.minimum(self.ends[first:last] - at, len(piece))
            out[first:last] = (total[ends] - total[starts]) * down[starts]
        return mix(out)


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~_SPACE[data]
    steps = np.diff(inside)
    # The block ends with a space, so every word has an end.
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    return Words(data, starts, ends, np.searchsorted(starts, edges), edges)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words of each text. A text with
    fewer words is one shingle; a text without words has none."""
    words = words_of(texts)
    one = words.hashes()
    runs = one.copy()
    for k in range(1, width):
        whole = max(0, len(one) - k)
        runs[:whole] = mix(
            runs[:whole] * np.uint64(0xD6E8FEB86659FD93) + one[k:] + np.uint64(k)
        )
    sets = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            short = b - a
            for h in one[a:b].tolist():
                short = (short * 31 + h) & _MASK
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
