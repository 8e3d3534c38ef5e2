"""Words and hashes of whole Arrow text columns, computed with numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that part words: space, and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_BASE, _PLACE = 0x9E3779B97F4A7C15, _RNG.integers(1, 1 << 63, 64, dtype=U64) | U64(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(which: str, n: int) -> np.ndarray:
    """The powers of an odd base, or of its inverse, modulo 2**64."""
    have = _POWERS[which]
    if len(have) < n:
        base = U64(_BASE if which == "up" else pow(_BASE, -1, 1 << 64))
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[which] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits of 64-bit hashes."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pieces(batch_col: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts (first row, end row, bytes, offsets) of a text column, of about ``most`` bytes each.

    A longer text makes a part of its own. Nulls count as empty texts.
    """
    col = batch_col.combine_chunks() if isinstance(batch_col, pa.ChunkedArray) else batch_col
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    _, where, data = col.buffers()
    offsets = np.frombuffer(where, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), len(col))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each row's words) with A-Z in lower case."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    data = LOWER[data]
    inside = ~SPACES[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers("up", len(data)), out=total[1:])
    found = (total[ends] - total[starts]) * powers("down", len(data))[starts]
    found = mixed(found + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return found, np.searchsorted(starts, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of ``width`` words.

    A row with fewer words has one: that of all its words. A row without words has none.
    """
    words, bounds = word_hashes(data, offsets)
    place = _PLACE[:width]
    if len(words) >= width:
        runs = np.zeros(len(words) - width + 1, U64)
        for k in range(width):
            runs += words[k : k + len(runs)] * place[k]
        runs = mixed(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * place[: b - a]).sum(dtype=U64) + U64(b - a)])))
        else:
            out.append(np.zeros(0, U64))
    return out
