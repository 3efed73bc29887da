"""Vectorised word spans, word hashes and shingle hashes over Arrow text.

All helpers work on the raw UTF-8 buffer of an Arrow string column, so that
no Python object per word is made. They are pure functions of the bytes:
any executor that repeats a task gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is still whole.
CHUNK_BYTES = 1_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64 values of a seed."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(11, 256)
_POSITION = stream(23, 64) | _U(1)
_BASE = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def ascii_class(word: bytes | None = None, space: bytes | None = None) -> np.ndarray:
    """256 flags: word bytes are those listed, or all but the listed spaces."""
    table = np.zeros(256, bool) if word is not None else np.ones(256, bool)
    table[list(word if word is not None else space or b"")] = word is not None
    return table


#: Words are maximal runs of anything but ASCII white space.
NOT_SPACE = ascii_class(space=b" \t\n\r\x0b\x0c")
#: Words are maximal runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM = ascii_class(word=b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``most`` bytes of text, each with its buffer."""
    raw, at = text_buffer(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (n + 1 values)."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    inside = is_word[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < len(raw)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def runs(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like spans, for maximal runs of bytes of one kind; kind 0 separates."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    k = kind[raw]
    edge = np.empty(len(k) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = k[1:] != k[:-1]
    edge[at] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(k))
    keep = k[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, the same wherever the word stands."""
    up, down = _power_tables(len(raw) + 1)
    total = np.empty(len(raw) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within each text, in order, and
    each text's first shingle (n + 1 values). A text of fewer words has its
    whole sequence as one shingle; a text without words has none."""
    n, count = len(words), np.diff(first)
    if n >= size:
        total = np.zeros(n - size + 1, _U)
        for j in range(size):
            total += words[j : n - size + 1 + j] * _POSITION[j]
        total = mix(total)
    else:
        total = np.zeros(0, _U)
    own = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(own)])
    out = np.empty(at[-1], _U)
    text = np.repeat(np.arange(len(count)), own)
    place = first[text] + np.arange(at[-1]) - at[text]
    whole = count[text] >= size
    out[whole] = total[place[whole]]
    for d in np.flatnonzero((count > 0) & (count < size)):
        part = words[first[d] : first[d + 1]]
        out[at[d]] = mix((part * _POSITION[: len(part)]).sum(dtype=_U, keepdims=True) + stream(len(part), 1))[0]
    return out, at
