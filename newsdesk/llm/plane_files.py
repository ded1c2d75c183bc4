"""A file format for token ids: blocks of fixed size, transposed into byte or bit planes, each plane in zstandard.

A file is segments one behind the other, each followed by one line feed (so that Spark's text sink can write them). A
segment holds whole documents in three columns: the document ids (eight bytes each, zero for a null), whether they are
given (one byte) and the documents' numbers of ids (eight bytes), and the ids of all documents one behind the
other, two or four bytes each. All numbers are little-endian. A segment is, in this order:

* the planes of every block, column by column, each plane one zstandard frame with its checksum; plane i of a block
  has byte i (or bit i) of all its numbers, the lowest first, bits packed eight to a byte from the lowest;
* the chunk index: a line per block (``INDEX``) with its column, kind of planes, width, number of values, first value
  and place in the segment, followed by the sizes of its planes, four bytes each;
* the footer (``FOOTER``): size of all before it, size and crc32 of the index, documents, ids, and the magic.

So a segment is read from its end, and any stretch of ids by the blocks that hold it alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"NDPLANE1"
INDEX = struct.Struct("<BBBxIQQ")
FOOTER = struct.Struct("<QQIQQ8s")
LINE_FEED = b"\n"
DOC_IDS, GIVEN, SIZES, IDS = range(4)
KINDS = {"byte": 0, "bit": 1}
BLOCK_IDS = 1 << 16
LEVEL = 3


def to_planes(values: np.ndarray, kind: int) -> np.ndarray:
    """One row per plane."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    if kind == KINDS["bit"]:
        raw = np.unpackbits(raw, axis=1, bitorder="little")
        return np.packbits(np.ascontiguousarray(raw.T), axis=1, bitorder="little")
    return np.ascontiguousarray(raw.T)


def from_planes(planes: np.ndarray, kind: int, dtype: np.dtype, n: int) -> np.ndarray:
    if kind == KINDS["bit"]:
        bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def segment(doc_ids: np.ndarray, given: np.ndarray, sizes: np.ndarray, ids: np.ndarray, planes: str = "byte", block: int = BLOCK_IDS) -> bytes:
    """The bytes of one segment; ``ids`` are unsigned, two or four bytes wide."""
    if ids.dtype not in (np.dtype("<u2"), np.dtype("<u4")):
        raise ValueError("ids are two or four bytes wide")
    kind, press = KINDS[planes], zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    body, index, at = [], [], 0
    for column, values in ((DOC_IDS, doc_ids.astype("<i8")), (GIVEN, given.astype("u1")), (SIZES, sizes.astype("<i8")), (IDS, ids)):
        for first in range(0, len(values), block):
            part = values[first : first + block]
            packed = [press.compress(plane.tobytes()) for plane in to_planes(part, kind)]
            index.append(INDEX.pack(column, kind, values.dtype.itemsize, len(part), first, at))
            index.append(np.array([len(x) for x in packed], "<u4").tobytes())
            body += packed
            at += sum(map(len, packed))
    index = b"".join(index)
    return b"".join(body) + index + FOOTER.pack(at + len(index), len(index), zlib.crc32(index), len(doc_ids), len(ids), MAGIC)


class Segment:
    """One segment: its chunk index at once, its columns block by block as they are asked for."""

    def __init__(self, data: memoryview, end: int):
        """The segment of ``data`` that ends at ``end``."""
        if end < FOOTER.size:
            raise ValueError("not a file of planes")
        size, index_size, checksum, self.n_docs, self.n_ids, magic = FOOTER.unpack(data[end - FOOTER.size : end])
        self.start = end - FOOTER.size - size
        if magic != MAGIC or self.start < 0 or index_size > size:
            raise ValueError("not a file of planes")
        self.data, index = data, data[end - FOOTER.size - index_size : end - FOOTER.size]
        if zlib.crc32(index) != checksum:
            raise ValueError("a damaged chunk index")
        self.blocks: list[list[tuple]] = [[], [], [], []]
        at = 0
        while at < len(index):
            column, kind, width, n, first, place = INDEX.unpack_from(index, at)
            planes = width * (8 if kind == KINDS["bit"] else 1)
            at += INDEX.size
            sizes = np.frombuffer(index, "<u4", planes, at)
            at += 4 * planes
            self.blocks[column].append((first, n, kind, width, place, sizes))

    def _block(self, column: int, entry: tuple) -> np.ndarray:
        _, n, kind, width, place, sizes = entry
        at, rows, reader = self.start + place, [], zstandard.ZstdDecompressor()
        for size in sizes.tolist():
            rows.append(np.frombuffer(reader.decompress(self.data[at : at + size]), np.uint8))
            at += size
        return from_planes(np.stack(rows), kind, np.dtype(f"<{'i' if column in (DOC_IDS, SIZES) else 'u'}{width}"), n)

    def _column(self, column: int, first: int, last: int) -> np.ndarray:
        found = [(e[0], self._block(column, e)) for e in self.blocks[column] if e[0] < last and e[0] + e[1] > first]
        if not found:
            return np.zeros(0, np.int64)
        values = np.concatenate([x for _, x in found])
        return values[first - found[0][0] : last - found[0][0]]

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, whether they are given, and the documents' bounds among the ids."""
        sizes = self._column(SIZES, 0, self.n_docs).astype(np.int64)
        return self._column(DOC_IDS, 0, self.n_docs).astype(np.int64), self._column(GIVEN, 0, self.n_docs) > 0, np.concatenate([[0], np.cumsum(sizes)])

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` up to ``last`` of the segment; only blocks that hold some of them are unpacked."""
        return self._column(IDS, first, last).astype(np.uint32)


def segments(content: bytes | memoryview) -> Iterator[Segment]:
    """The segments of a file, in order."""
    data, found = memoryview(content), []
    end = len(data)
    while end:
        if bytes(data[end - 1 : end]) != LINE_FEED:
            raise ValueError("not a file of planes")
        found.append(Segment(data, end - 1))
        end = found[-1].start
    yield from reversed(found)
