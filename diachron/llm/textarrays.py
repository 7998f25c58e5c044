"""Texts as arrays of code points: tokens, their fingerprints and per-document statistics.

Documents are taken in groups of bounded size, so memory does not follow the batch. A single text
longer than the bound forms a group of its own.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GROUP_CHARS = 1 << 18
#: Code points below this have their own class and lower case; the ideographs and signs beyond count as letters.
KNOWN = 0x20000
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and whether upper case, by code point below ``KNOWN``."""
    kind = np.full(KNOWN + 1, LETTER, np.uint8)
    low = np.arange(KNOWN + 1, dtype=np.uint32)
    upper = np.zeros(KNOWN + 1, bool)
    for c in range(KNOWN):
        x = chr(c)
        kind[c] = SPACE if x.isspace() or c < 32 else LETTER if x.isalpha() or unicodedata.category(x)[0] == "M" else DIGIT if x.isdigit() else OTHER
        if len(x.lower()) == 1:
            low[c] = ord(x.lower())
        upper[c] = x.isupper()
    return kind, low, upper


def binary(prints: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as binary values in their order; null where not ``some``."""
    width = 8 * prints.shape[1]
    offsets = np.arange(len(prints) + 1, dtype=np.int32) * width
    valid = pa.array(np.ascontiguousarray(some), pa.bool_()).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(prints), [valid, pa.py_buffer(offsets), pa.py_buffer(prints.astype(">u8").tobytes())])


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(18, int(n).bit_length()))


class Group:
    """Some documents: ``codes`` (one line feed ends each), ``ends``, classes and lower case."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.lengths = np.diff(self.ends, prepend=0) - 1
        kind, low, _ = tables()
        beyond = len(self.codes) > 0 and self.codes.max() >= KNOWN
        self._small = np.minimum(self.codes, KNOWN) if beyond else self.codes
        self.kind, self.low = kind[self._small], low[self._small]
        if beyond:
            self.low = np.where(self.codes < KNOWN, self.low, self.codes)

    @property
    def upper(self) -> np.ndarray:
        return tables()[2][self._small]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of letters and digits."""
        inside = np.zeros(len(self.kind) + 2, bool)
        inside[1:-1] = (self.kind == LETTER) | (self.kind == DIGIT)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    def runs(self, kind: np.ndarray, single: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of one class; 0 is between runs, ``single`` does not run."""
        before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
        own = kind == single if single is not None else np.zeros(len(kind), bool)
        inside = kind != 0
        return np.flatnonzero(inside & ((kind != before) | own)), np.flatnonzero(inside & ((kind != after) | own)) + 1

    def prints(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of lower-cased runs."""
        up, down = powers(len(self.low))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[: len(self.low)], dtype=np.uint64)])
        return mix((total[stops] - total[starts]) * down[starts])

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-character array by document."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(total[np.concatenate([[0], self.ends])])


def groups(texts: list[str]) -> Iterator[tuple[int, Group]]:
    """Index of the first document and the group, for all texts in order."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > GROUP_CHARS:
            yield start, Group(texts[start:i])
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, Group(texts[start:])
