"""Vectorised helpers over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240601)
#: A random odd 64-bit value for each byte, in two lanes.
BYTE_CODES = tuple(_RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1) for _ in range(2))
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: Bytes that part words: space and the controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings end to end, and where each begins (one more offset than strings). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def int64(column: pa.ChunkedArray | pa.Array, null: int = 2**63 - 1) -> np.ndarray:
    """Integers; null sorts behind all others."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else int64(column.combine_chunks(), null)


def slices(offsets: np.ndarray, most: int):
    """Ranges (i, j) of strings with about ``most`` bytes each, one string at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each string's first word (one more than strings)."""
    inside = ~parting[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each word, mixed; equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=total[1:])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    codes = BYTE_CODES[lane][data[place + np.repeat(starts, lengths)]]
    codes *= powers(BASES[lane], int(lengths.max()))[place]
    sums = np.zeros(total[-1] + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    return mix(sums[total[1:]] - sums[total[:-1]] + lengths.astype(np.uint64))


def rolling(codes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each window of ``k`` codes; the last k - 1 places hold windows that run over the end."""
    n, base = len(codes), BASES[lane]
    out, done, run, length = None, 0, codes, 1
    while k:
        if k & 1:
            if out is None:
                out = run.copy()
            else:
                out *= U64(pow(base, length, 2**64))
                out[: n - done] += run[done:] if done < n else 0
            done += length
        k >>= 1
        if k:
            grown = run * U64(pow(base, length, 2**64))
            if length < n:
                grown[: n - length] += run[length:]
            run, length = grown, 2 * length
    return out


def sliding(values: np.ndarray, w: int, take=np.minimum) -> np.ndarray:
    """take over values[i : i + w] for each i (shorter at the end)."""
    out, length = values.copy(), 1
    while length < w:
        step = min(length, w - length)
        if step < len(out):
            out[:-step] = take(out[:-step], out[step:])
        length += step
    return out


def trailing(values: np.ndarray, w: int, take=np.maximum) -> np.ndarray:
    """take over values[i - w + 1 : i + 1] for each i (shorter at the start)."""
    return sliding(values[::-1], w, take)[::-1]


def run_ends(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + lengths, n), -1)
    return np.cumsum(depth[:n]) > 0
