"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D. Texts are taken in slabs of a quarter megabyte,
so that memory follows the slab, or the longest single text, and never the partition. Null texts
count as empty.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x2545F4914F6CDD1D  # odd, hence invertible modulo 2**64


class Powers:
    """Powers of BASE and of its inverse, grown when a longer slab comes."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            grow = lambda base: np.multiply.accumulate(
                np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])
            )
            self.up, self.down = grow(BASE), grow(inverse)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def rolling(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[begin:end] for each pair, whatever its place."""
    up, down = POWERS.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


class Texts:
    """Some texts: `data` holds their bytes, text i lies at `at[i]:at[i + 1]`."""

    def __init__(self, column: pa.Array, fold: bool):
        raw = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = raw.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        if fold:
            self.data = FOLD[self.data]
        self.n = len(raw)

    def words(self) -> "Words":
        return Words(self)


class Words:
    """`begin`, `end`: byte range of each word; `hash`: of its bytes; text i has the words first[i]:first[i + 1]."""

    def __init__(self, texts: Texts):
        data, at = texts.data, texts.at
        size = len(data)
        inside = ~SPACE[data]
        edge = np.zeros(size + 1, bool)
        edge[at] = True
        left = inside.copy()
        left[1:] &= ~inside[:-1] | edge[1:size]
        right = inside.copy()
        right[:-1] &= ~inside[1:] | edge[1:size]
        self.texts = texts
        self.begin = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        self.first = np.searchsorted(self.begin, at)
        self.count = np.diff(self.first)
        self.hash = rolling(BYTE_CODE[data], self.begin, self.end)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and hashes of all windows of k words that lie within one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends = np.repeat(self.first[1:], self.count)
        starts = np.flatnonzero(np.arange(n) + k <= ends)
        return starts, rolling(self.hash, starts, starts + k)


def slabs(batch: pa.RecordBatch, fold: bool, column: str = "text", size: int = SLAB_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(lo, hi, texts of the rows lo:hi), each of about `size` bytes, or one text if that is longer."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    total = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + size, "right")) - 1)
        yield lo, hi, Texts(texts.slice(lo, hi - lo), fold)
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
