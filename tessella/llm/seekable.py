"""A file of token ids as independent zstandard frames with a trailing seek table.

Layout: data frames (each with its own content checksum), a skippable frame with the document index, and a skippable
frame with the seek table in the public seekable format of zstandard: compressed size, size and checksum of each frame,
then the number of frames, a descriptor byte and a magic number. Any zstandard reader can decompress the whole file.
"""

from __future__ import annotations

import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

# Fixed values of the public seekable format.
SKIP_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
#: The document index has a skippable frame of another number.
SKIP_INDEX = 0x184D2A50
FRAME_BYTES = 1 << 20
_DOC = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n", "<u8"), ("null", "u1")])


class Writer:
    """Appends documents to an open binary file; a frame is closed at frame_bytes, so long documents span frames."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.out, self.frame_bytes = out, frame_bytes // 4 * 4
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.buffer, self.table, self.tokens = bytearray(), [], 0
        self.index = array("q"), array("Q"), array("Q"), array("B")  # as in _DOC

    def __len__(self) -> int:
        return len(self.index[0])

    def add(self, doc_id: int | None, ids: bytes) -> None:
        for column, x in zip(self.index, (doc_id or 0, self.tokens, len(ids) // 4, doc_id is None), strict=True):
            column.append(x)
        self.tokens += len(ids) // 4
        self.buffer += ids
        while len(self.buffer) >= self.frame_bytes:
            self._frame(self.frame_bytes)

    def _frame(self, n: int) -> None:
        data = bytes(self.buffer[:n])
        del self.buffer[:n]
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), n, xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self._frame(len(self.buffer))
        docs = np.empty(len(self), _DOC)
        for name, column in zip(_DOC.names, self.index, strict=True):
            docs[name] = np.frombuffer(column, column.typecode) if len(column) else 0
        index = docs.tobytes()
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index) + 8) + index + struct.pack("<Q", len(docs)))
        table = b"".join(struct.pack("<III", *row) for row in self.table)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))


class Reader:
    """Reads documents of a file through its seek table; only the frames that hold them are decompressed."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not descriptor & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        at = end - 9 - 12 * n - 8
        file.seek(at)
        table = np.frombuffer(file.read(12 * n + 8)[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        file.seek(at - 8)
        (docs,) = struct.unpack("<Q", file.read(8))
        file.seek(at - 8 - docs * _DOC.itemsize)
        self.docs = np.frombuffer(file.read(docs * _DOC.itemsize), _DOC)
        self.zstd = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.packed[k]))
        data = self.zstd.decompress(self.file.read(int(self.packed[k + 1] - self.packed[k])))
        self.frames_read += 1
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return data

    def ids(self, positions) -> Iterator[np.ndarray]:
        """The ids of the documents at these positions of the index, in the order given."""
        last, data = -1, b""
        for p in positions:
            a, b = int(self.docs["start"][p]) * 4, int(self.docs["start"][p] + self.docs["n"][p]) * 4
            parts = []
            while a < b:
                k = bisect_right(self.plain, a) - 1
                if k != last:
                    last, data = k, self.frame(k)
                base = int(self.plain[k])
                parts.append(data[a - base : b - base])
                a = min(b, int(self.plain[k + 1]))
            yield np.frombuffer(b"".join(parts), "<u4")

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document in the index."""
        return np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["null"] == 0)).tolist()
