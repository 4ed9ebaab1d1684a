"""Whole texts as numpy arrays: words, word codes and word hashes of an Arrow column, in blocks of bounded memory."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. A longer text comes alone and whole; what is computed of it takes some ten times its size.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
MULTIPLIERS = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: The six bytes that part words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_base = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


_state: dict = {}


def worker_state(key, make: Callable):
    """What one operator keeps in this worker process between tasks, made once. Workers are shared: the state of the
    operator that had it before goes first, so that their memory does not add up. key None only frees it."""
    if _state.get("key") != key:
        _state.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it frees memory in its own way
            pass
        _state["key"] = key
    if key is not None and "made" not in _state:
        _state["made"] = make()
    return _state.get("made")


@contextmanager
def no_cycles() -> Iterator[None]:
    """Within it, the garbage collector rests: caches hold no cycles, and walking them again and again is dear."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def fresh(base: str, names: list[str]) -> str:
    """A column name that begins with base and is no beginning of any of names, whatever their case."""
    while any(n.lower().startswith(base.lower()) for n in names):
        base += "_"
    return base


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def blocks(text: np.ndarray, at: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) of runs of rows that have at most ``most`` bytes; a longer row comes alone, whole."""
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield text[at[row] : at[end]], at[row : end + 1] - at[row], row
        row = end


class Words:
    """Words of a block: start, end and row of each, in order."""

    def __init__(self, text: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACES):
        self.text, self.at = text, at
        inside = ~apart[text]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(text))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(at, self.start, side="right") - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.at) - 1)

    def hashes(self, fold: np.ndarray = IDENTITY) -> np.ndarray:
        """A 64-bit hash of each word after ``fold`` of its bytes; equal words have equal hashes wherever they stand."""
        out, done, n = np.empty(len(self.start), np.uint64), 0, len(self.start)
        table = BYTE_CODES[fold]
        while done < n:
            low = self.start[done]
            last = max(int(np.searchsorted(self.end, low + BLOCK // 4, side="right")), done + 1)
            high = self.end[last - 1]
            power, inverse = _power_tables(high - low)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[self.text[low:high]] * power, out=total[1:])
            s, e = self.start[done:last] - low, self.end[done:last] - low
            out[done:last] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            done = last
        return out

    def codes(self, fold: np.ndarray = IDENTITY) -> np.ndarray:
        """The first eight bytes of each word as one integer, filled up with zeros."""
        size = self.end - self.start
        out = np.zeros(len(size), np.uint64)
        for j in range(8):
            has = size > j
            out[has] |= fold[self.text[self.start[has] + j]].astype(np.uint64) << np.uint64(8 * j)
        return out


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_powers.get("p", ()))
    if have < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_base), -1, 2**64))
        for name, base in (("p", _base), ("i", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    p, i = _powers["p"][:n], _powers["i"][:n]
    if n > BLOCK:  # a huge word: do not keep its tables
        _powers.clear()
    return p, i


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words in a row; a row with fewer words has one for its whole sequence."""
    n = len(h)
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    parts, rows = [], []
    if n >= size:
        same = row[: n - size + 1] == row[size - 1 :]
        total = np.full(n - size + 1, np.uint64(size * int(MULTIPLIERS[size]) % 2**64))
        for j in range(size):
            total = total + h[j : n - size + 1 + j] * MULTIPLIERS[j]
        parts.append(mix64(total[same]))
        rows.append(row[: n - size + 1][same])
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            total = np.full(len(short), np.uint64(k * int(MULTIPLIERS[size]) % 2**64))
            for j in range(k):
                total = total + h[first[short] + j] * MULTIPLIERS[j]
            parts.append(mix64(total))
            rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, where = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(where, kind="stable")
    return out[order], where[order]
