"""Vectorised scans of Arrow text columns: bytes, words, hashes and shingles.

All functions see UTF-8 bytes. A word is a run of bytes other than 0x20 and 0x09-0x0D, after A-Z are
lower-cased. Hashes read eight bytes at a time and mix after each step, so that no pattern of bytes cancels out as
it would in a polynomial modulo 2**64; bytes of up to seven get different hashes for certain, longer ones share one
with a chance of 2**-64 a pair. Where equality alone decides a result, ``same_bytes`` compares the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled by itself, at about ten bytes of memory a byte.
CHUNK_BYTES = 1 << 19
#: Beyond so many bytes a range is hashed by itself, with BLAKE2.
LONG_RANGE = 96
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values, one to one."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _absorb(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The state h after the value x; one to one in either."""
    h = h * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h += x
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text, with bytes and row offsets of the text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand. Lanes are independent."""
    at, n = eights(data), ends - starts
    h = at[starts] & _LOW_BYTES[np.minimum(n, 8)]
    short = n < 8  # their length goes into the free byte; the others start from another state
    h |= np.where(short, n, 0).astype(_U) << _U(56)
    h = _absorb(np.where(short, _U(0xA0761D6478BD642F + 2 * lane), _U(0xE7037ED1A0B428DB + 2 * lane) + n.astype(_U)), h)
    left, done = np.flatnonzero(n > 8), 8
    while len(left) and done < LONG_RANGE:
        rest = n[left] - done
        h[left] = _absorb(h[left], at[starts[left] + done] & _LOW_BYTES[np.minimum(rest, 8)])
        left, done = left[rest > 8], done + 8
    for i in left.tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([lane])).digest()
        h[i] = int.from_bytes(digest, "little")
    return mix(h)


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each range holds the bytes of the other range beside it."""
    at, n = eights(data), ends - starts
    same = n == other_ends - others
    left, done = np.flatnonzero(same), 0
    while len(left):
        keep = _LOW_BYTES[np.minimum(n[left] - done, 8)]
        alike = ((at[starts[left] + done] ^ at[others[left] + done]) & keep) == 0
        same[left[~alike]] = False
        done += 8
        left = left[alike & (n[left] > done)]
    return same


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order of appearance, where each stands first, and the number of each value among them."""
    coded = pa.array(values).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return coded.dictionary.to_numpy(), first, number


def factorize(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct range, by its bytes: places of the first of each, and the number of each range."""
    _, first, number = distinct(range_hash(data, starts, ends))
    if same_bytes(data, starts, ends, starts[first[number]], ends[first[number]]).all():
        return first, number
    raw, seen, first, number = data.tobytes(), {}, [], np.empty(len(starts), np.int64)  # equal hashes of different bytes
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        number[i] = seen.setdefault(raw[a:b], len(seen))
        if number[i] == len(first):
            first.append(i)
    return np.array(first, np.int64), number


def window_hash(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each place on (a multiple of 8, at least 16)."""
    out, have, known = np.ascontiguousarray(eights(data)[:-1]), 8, {}
    while True:
        known[have] = out
        if have * 2 > width:
            break
        out = _absorb(out[:-have], out[have:])
        have *= 2
    for part in sorted(known, reverse=True):
        while have + part <= width:
            n = len(data) - have - part + 1
            out = _absorb(out[: max(n, 0)], known[part][have : have + max(n, 0)])
            have += part
    return mix(out[: max(len(data) - width + 1, 0)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the place of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = IS_WORD[data]
    first, last = w.copy(), w.copy()
    np.greater(w[1:], w[:-1], out=first[1:])
    np.greater(w[:-1], w[1:], out=last[:-1])
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = w[inner]
    before = inner[inner > 0] - 1
    last[before] = w[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes (of lower-cased bytes) and row pointers of all words."""
    low = LOWER[data]
    starts, ends, ptr = words(low, offsets)
    return starts, ends, range_hash(low, starts, ends, lane), ptr


_STEP = _U(0xD6E8FEB86659FD93)


def sequence_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : j + n]
        out ^= out >> _U(29)
    return mix(out)


def shingle_sets(hashes: np.ndarray, ptr: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    runs = sequence_hash(hashes, k)
    out = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(sequence_hash(hashes[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.zeros(0, _U))
    return out


def int64(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's long, bit by bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def blobs(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Rows ptr[i] .. ptr[i + 1] of values as binary."""
    values = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer((ptr * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def unblob(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary rows without nulls, and row pointers into them."""
    _, offs, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8 if column.type == pa.large_binary() else 0)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
