"""Normalised indel similarity: 200 * LCS(a, b) / (len(a) + len(b))."""

import sys
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from .text import col

# workers need no copy of this package: the functions below travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


CHUNK_BITS = 16_384
SLOTS = 32  # characters are counted by code point modulo this
MOST = 16_000  # what a count is cut to: differences only shrink
HELD_CHARACTERS = 1_000_000  # keys whose characters' places a task remembers
TILE = 8_192  # keys that one key is held against at once
BEGIN = 3.2  # of how many times the allowed insertions and deletions the beginning of a key is long
BEGIN_FROM = 128  # characters of a key from which on its beginning is compared first
BEGIN_BITS = 1 << 15  # characters of beginnings that are compared at once
NO_CHARACTER = 255
FIRST = 8  # closest keys that are compared at once if one match is enough


def _places(a: str) -> dict[str, int]:
    """Character -> bits of the positions it stands at."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    return where


def _lcs_chunk(b: str, partners, places: dict) -> list[int]:
    """LCS lengths of one text with several, all in one pass over it.

    Bit-parallel LCS (Hyyro 2004) on one long integer: the partners lie side by side with an
    unused bit between them, which takes up the carry of the addition.
    """
    needed = set(b)
    where: dict[str, int] = {}
    full = offset = 0
    for a in partners:
        if a not in places:
            places[a] = _places(a)
        for ch, bits in places[a].items():
            if ch in needed:
                where[ch] = where.get(ch, 0) | (bits << offset)
        full |= ((1 << len(a)) - 1) << offset
        offset += len(a) + 1
    row = full
    for ch in b:
        bits = where.get(ch)
        if bits:
            hit = row & bits
            row = ((row + hit) | (row ^ hit)) & full
    found, offset = [], 0
    for a in partners:
        found.append(len(a) - ((row >> offset) & ((1 << len(a)) - 1)).bit_count())
        offset += len(a) + 1
    return found


def _lcs_pairs(a, b) -> list[int]:
    """LCS length per pair; pairs with the same `b` are worked off together."""
    out = [0] * len(b)
    places: dict[str, dict[str, int]] = {}
    same: dict[str, list[int]] = {}
    for i, text in enumerate(b):
        same.setdefault(text, []).append(i)
    for text, rows in same.items():
        chunk, bits = [], 0
        for i in [*rows, None]:
            if chunk and (i is None or bits + len(a[i]) > CHUNK_BITS):
                for j, n in zip(chunk, _lcs_chunk(text, [a[j] for j in chunk], places)):
                    out[j] = n
                chunk, bits = [], 0
            if i is not None:
                chunk.append(i)
                bits += len(a[i]) + 1
    return out


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence; fastest where rows with the same `b` lie in one partition."""
    return pd.Series(_lcs_pairs(a.tolist(), b.tolist()), dtype="int32")


def similarity(a, b) -> Column:
    total = F.length(col(a)) + F.length(col(b))
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(col(a), col(b)) / total)


def reaches(a, b, threshold: int) -> Column:
    """Similarity >= threshold, in whole numbers."""
    total = F.length(col(a)) + F.length(col(b))
    return 200 * lcs_length(col(a), col(b)) >= threshold * total


def _some(keys):
    """Slices of keys, of few characters each."""
    begin = size = 0
    for i, key in enumerate(keys):
        if size > HELD_CHARACTERS:
            yield keys[begin:i]
            begin, size = i, 0
        size += len(key)
    yield keys[begin:]


def _code_points(keys) -> np.ndarray:
    return np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)


def _bags(keys) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and per key how often its characters occur, by slot."""
    sizes, counts = np.array([len(k) for k in keys], np.int64), []
    for some in _some(keys):
        of = np.repeat(np.arange(len(some)) * SLOTS, [len(k) for k in some]) + _code_points(some) % SLOTS
        bags = np.bincount(of, minlength=len(some) * SLOTS).reshape(len(some), SLOTS)
        counts.append(np.minimum(bags, MOST).astype(np.int16))
    return sizes, np.concatenate(counts)


def _folded(keys) -> np.ndarray:
    """All characters in a row, by code point modulo `NO_CHARACTER`."""
    return np.concatenate([(_code_points(some) % NO_CHARACTER).astype(np.uint8) for some in _some(keys)])


def by_length(ranks, keys):
    """Ranks, keys and lengths, shortest first, the bags by slot, and the characters."""
    sizes, bags = _bags(keys)
    order = np.argsort(sizes, kind="stable")
    keys = [keys[i] for i in order]
    return np.asarray(ranks, np.int64)[order], keys, sizes[order], np.ascontiguousarray(bags[order].T), _folded(keys)


def _gaps(bags, some: slice, own, total: int) -> np.ndarray:
    """By how much the counts of the keys `some` differ from `own`, summed over the slots."""
    # differences of keys of so many characters together sum up to no more
    gap = np.zeros(some.stop - some.start, np.int16 if total < 1 << 15 else np.int32)
    one = np.empty(len(gap), np.int16)
    for slot in range(SLOTS):
        np.subtract(bags[slot, some], own[slot], out=one)
        np.abs(one, out=one)
        gap += one
    return gap


def _begin_alike(key: str, threshold: int, sizes, starts, chars) -> np.ndarray:
    """Which keys (their sizes and starts in `chars`) may match `key`, by the beginnings of both.

    Where the key's first characters end, a common subsequence is at some place of the other key. Insertions and deletions
    up to there are known from the bits of one pass over the beginning, and what remains of both differs by as many at
    least as in length. Characters that fold into one only let more keys pass.
    """
    size, spare = len(key), 100 - threshold
    j = int(BEGIN * spare * size / 100)
    # no place further on is reached with so many deletions
    width = j + int(np.max(sizes - threshold * (sizes + size) // 200))
    if not j or width > sizes.min():
        return np.ones(len(sizes), bool)
    table = np.full((len(sizes), width + 1), NO_CHARACTER, np.uint8)
    table[:, :width] = chars[starts[:, None] + np.arange(width)]
    table = table.ravel()

    def bits(some):
        return int.from_bytes(np.packbits(some, bitorder="little").tobytes(), "little")

    begin = _folded([key[:j]]).tolist()
    where = {ch: bits(table == ch) for ch in set(begin)}
    row = full = bits(table != NO_CHARACTER)
    for ch in begin:
        hit = row & where[ch]
        if hit:
            row = ((row + hit) | (row ^ hit)) & full
    left = np.frombuffer(row.to_bytes(-(-len(table) // 8), "little"), np.uint8)
    left = np.unpackbits(left, count=len(table), bitorder="little").reshape(-1, width + 1)[:, :width]
    # x - common, for each place x
    lost = np.zeros((len(sizes), width + 1), np.int32)
    np.cumsum(left, axis=1, dtype=np.int32, out=lost[:, 1:])
    x = np.arange(width + 1, dtype=np.int32)
    rest = (sizes - size + j).astype(np.int32)[:, None] - x
    least = (2 * lost - x + j + np.abs(rest)).min(axis=1)
    return 100 * least.astype(np.int64) <= spare * (sizes + size)


def near_pairs(batches, left, threshold: int, ordered: bool, single: bool, names):
    """(a, b, ka, kb) or with `single` (b): rows of (rank, key) next to those of `left` (`by_length`) that match them.

    Each key is held against all of `left` of a length that fits, by their bags: an insertion or deletion moves
    one count by one. Of long ones that are left the beginnings are compared, and what then is left is compared whole, so
    that no pair that does not match leaves the task. With `single` the first match of a key is enough.
    """
    ranks, keys, sizes, bags, chars = left
    low, high, spare = threshold, 200 - threshold, 100 - threshold
    starts = np.cumsum(sizes) - sizes
    places, held = {}, 0

    def groups(key, near):
        """Keys to compare at once, with `single` the closest first."""
        if len(key) < BEGIN_FROM:
            step = FIRST if single else max(1, len(near))
            yield from (near[i : i + step].tolist() for i in range(0, len(near), step))
            return
        step = max(1, int(BEGIN_BITS / (BEGIN * spare / 100 * len(key) + 1)))
        rest = np.sort(near[FIRST:]) if single else near
        for some in chain([near[:FIRST]] if single else [], (rest[i : i + step] for i in range(0, len(rest), step))):
            yield some[_begin_alike(key, threshold, sizes[some], starts[some], chars)].tolist()

    def matching(key, near):
        nonlocal places, held
        chunk, bits = [], 0
        for j in [*near, None]:
            if chunk and (j is None or bits + sizes[j] > CHUNK_BITS):
                held += sum(len(keys[c]) for c in chunk if keys[c] not in places)
                lengths = _lcs_chunk(key, [keys[c] for c in chunk], places)
                yield from [c for c, n in zip(chunk, lengths) if 200 * n >= threshold * (len(keys[c]) + len(key))]
                if held > HELD_CHARACTERS:
                    places, held = {}, 0
                chunk, bits = [], 0
            if j is not None:
                chunk.append(j)
                bits += sizes[j] + 1

    for batch in batches:
        found = ([], [])
        own_ranks, own_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        own_sizes, own_bags = _bags(own_keys)
        begins = np.searchsorted(sizes, -(-low * own_sizes // high), "left")
        ends = np.searchsorted(sizes, high * own_sizes // low, "right")
        # keys of like length in a row meet the same ones of `left`
        for i in np.argsort(own_sizes, kind="stable").tolist():
            rank, key = own_ranks[i], own_keys[i]
            near, gaps = [], []
            for begin in range(begins[i], ends[i], TILE):
                some = slice(begin, min(begin + TILE, ends[i]))
                gap = _gaps(bags, some, own_bags[i], int(own_sizes[i] + sizes[some.stop - 1]))
                fit = 100 * gap.astype(np.int32) <= spare * (sizes[some] + own_sizes[i])
                if ordered:
                    fit &= ranks[some] < rank
                at = np.flatnonzero(fit)
                near.append(at + begin)
                gaps.append(gap[at])
            near = np.concatenate(near) if near else ()
            if not len(near):
                continue
            if single:  # the closest first
                near = near[np.argsort(np.concatenate(gaps), kind="stable")]
            hits = chain.from_iterable(matching(key, some) for some in groups(key, near))
            hits = list(islice(hits, 1) if single else hits)
            found[0].extend(hits)
            found[1].extend([i] * len(hits))
        a, b = found
        columns = [pa.array([own_ranks[i] for i in b], pa.int64())]
        if not single:
            columns = [
                pa.array(ranks[a] if a else [], pa.int64()), *columns,
                pa.array([keys[j] for j in a], pa.string()), pa.array([own_keys[i] for i in b], pa.string()),
            ]
        yield pa.RecordBatch.from_arrays(columns, names)
