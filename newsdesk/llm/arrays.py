"""Whole Arrow batches of texts as numpy arrays: bytes, words and hashes, without a loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE_BYTES = 1 << 20
"""Text of one numpy pass; an array of words or hashes then takes some tens of MB."""

# Odd multipliers of the polynomial hashes and of the final mix (any odd numbers do).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


_stores: list[Callable[[], None]] = []
"""What empties a store that tasks of one Python worker share."""


def emptied_by(clear: Callable[[], None]) -> None:
    _stores.append(clear)


def fresh_memory() -> None:
    """Give back what earlier tasks of this Python worker have left: stores of other operators, and free pages."""
    for clear in _stores:
        clear()
    free_pages()


def free_pages() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most ``most`` bytes, or one row that holds more."""
    if not batch.num_rows:
        return
    _, off = byte_view(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def byte_view(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' bounds in them; a null is an empty text."""
    if text.null_count:
        text = pc.fill_null(text, "" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    _, offsets, data = text.buffers()
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse; grown as longer inputs come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = (np.full(size, b, np.uint64) for b in (self.base, self.inverse))
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def prefix_hash(symbols: np.ndarray, powers: Powers) -> np.ndarray:
    """Running polynomial sums; ``range_hash`` takes any range's hash from them."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    up, _ = powers.upto(len(symbols) + 1)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Equal for ranges of equal symbols, wherever they stand."""
    _, down = powers.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] ^ ((end - start).astype(np.uint64) * np.uint64(MIX_1)))


class Words:
    """The words of a run of texts: byte ranges, row of each, and the rows' bounds among them."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool, space: np.ndarray = SPACE):
        self.raw = LOWER[raw] if lower else raw
        space = space[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[off] = True
        inside = ~space
        edge = first[:-1] | np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(inside & edge)
        edge = first[1:] | np.concatenate([space[1:], [True]])
        self.end = np.flatnonzero(inside & edge) + 1
        self.bounds = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(self.raw, BYTE_POWERS), self.start, self.end, BYTE_POWERS)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words of one row, and the place of their first word."""
        last = self.bounds[1:][self.row] - n
        at = np.flatnonzero(np.arange(len(self)) <= last)
        prefix = prefix_hash(self.hashes(), WORD_POWERS)
        return range_hash(prefix, at, at + n, WORD_POWERS), at


def words_of(text: pa.Array, lower: bool = False) -> Words:
    return Words(*byte_view(text), lower)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles as (row, hash), ordered by both.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    hashes, at = words.windows(n)
    rows = words.row[at]
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        prefix = prefix_hash(words.hashes(), WORD_POWERS)
        hashes = np.concatenate([hashes, range_hash(prefix, words.bounds[short], words.bounds[short + 1], WORD_POWERS)])
        rows = np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def squeezed(text: pa.Array) -> pa.Array:
    """Each text's UTF-8 in zstd, for a shuffle of texts; a null is an empty text."""
    raw, off = byte_view(text)
    data, press = raw.tobytes(), zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(data[a:b]) for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)], pa.binary())


def unsqueezed(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with ``text`` unpacked again, each of about ``most`` bytes."""
    at = batch.schema.get_field_index("text")
    reader, texts, size, start = zstandard.ZstdDecompressor(), [], 0, 0
    for i, packed in enumerate(batch.column(at)):
        texts.append(reader.decompress(packed.as_buffer()))
        size += len(texts[-1])
        if size >= most or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start).set_column(at, "text", pa.array(texts, pa.binary()))
            texts, size, start = [], 0, i + 1


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key``, from batches sorted by it; a group may run over several batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
