"""Moving sorted 64-bit hashes between tasks as compressed arrays.

A task sorts what it has made, cuts it by hash range, and sends every range as one row: differences of
the hashes and the numbers that go with them, byte plane by byte plane. That takes a fraction of the
bytes that one row for each hash would, and the receiving side works on arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ASCII_LOWER

U64 = np.uint64
#: Entries that a task gathers before it sends them.
BLOCK = 3_000_000
MEMORY = 200_000
LONG = 200
#: Ranges that a block is cut into at once; payload bytes that the second cut of many ranges takes at once.
FANOUT, SECOND = 2048, 48 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range, of `parts` equal ones, in the order of the hashes."""
    return ((h >> U64(32)) * U64(parts)) >> U64(32)


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned or signed 64-bit numbers, less the least of them, as byte planes of the width that they need."""
    values = values.astype(np.int64, copy=False).view(U64) if values.dtype != U64 else values
    low = int(values.view(np.int64).min()) if len(values) else 0
    rest = values - U64(low % 2**64)
    width = (int(rest.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<Iqb", len(values), low, width) + planes.tobytes()


def unpack_ints(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    n, low, width = struct.unpack_from("<Iqb", data, at)
    at += 13
    out = np.zeros((n, 8), dtype=np.uint8)
    if width:
        out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return (out.view(U64)[:, 0] + U64(low % 2**64)), at + n * width


def pack(columns: list[np.ndarray], ascending: bool = True) -> bytes:
    """Columns of 64-bit numbers; the first is sent as differences if it ascends."""
    first = columns[0]
    if ascending and len(first):
        first = np.concatenate([first[:1], np.diff(first)]).astype(U64)
        data = pack_ints(first[:1]) + pack_ints(first[1:])
    else:
        data = pack_ints(first[:0]) + pack_ints(first)
    return zstandard.ZstdCompressor(level=1).compress(data + b"".join(map(pack_ints, columns[1:])))


def unpack(payload: bytes, columns: int) -> list[np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(payload))
    head, at = unpack_ints(data, 0)
    first, at = unpack_ints(data, at)
    if len(head):
        first = np.cumsum(np.concatenate([head, first]), dtype=U64)
    out = [first]
    for _ in range(columns - 1):
        column, at = unpack_ints(data, at)
        out.append(column)
    return out


def runs(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of each part in an ascending array."""
    if len(parts):
        at = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        yield from zip(parts[at].tolist(), at.tolist(), [*at[1:].tolist(), len(parts)], strict=True)


def dealt(keys: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """(range, payload) of entries sorted by key, for every range that has some."""
    for p, a, b in runs(part_of(keys, parts)):
        yield p, pack([keys[a:b], *[c[a:b] for c in columns]])


class Ranges:
    """How entries are dealt into hash ranges.

    Up to FANOUT ranges a block is cut into all of them. With more, blocks are cut into coarse ranges first, and what
    a coarse range has is gathered into new blocks that are cut into its fine ones. So a payload stays large however many ranges there are.
    """

    def __init__(self, parts: int, fanout: int | None = None):
        fanout = fanout or FANOUT
        self.coarse = -(-parts // fanout) if parts > fanout else 0
        self.fine = fanout if self.coarse else 1
        self.parts = self.coarse * fanout if self.coarse else parts
        self.first = self.coarse or parts

    def grouped(self, rows: DataFrame, again: Callable[[int, int, list[bytes]], Iterator[tuple[int, int, bytes]]]):
        """rows (part, a flag or kind, payload), dealt into the `first` ranges, grouped by the range of `parts`.

        again: coarse range, flag or kind, and payloads -> rows by fine ranges. A range has a task of its own.
        """
        if self.coarse:
            names, kind = rows.columns, pa.bool_() if dict(rows.dtypes)[rows.columns[1]] == "boolean" else pa.int32()

            def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: dict[tuple[int, int], list[bytes]] = {}
                size: dict[tuple[int, int], int] = {}

                def out(key: tuple[int, int]) -> pa.RecordBatch:
                    made = list(again(*key, held.pop(key)))
                    size.pop(key)
                    columns = zip(*made, strict=True) if made else ([], [], [])
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), kind, pa.binary()), strict=True)], names=names)

                for batch in batches:
                    for part, flag, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        held.setdefault((part, flag), []).append(payload)
                        size[part, flag] = size.get((part, flag), 0) + len(payload)
                        if size[part, flag] >= SECOND:
                            yield out((part, flag))
                for key in list(held):
                    yield out(key)

            rows = rows.repartitionById(self.coarse, F.col("part")).mapInArrow(cut, rows.schema)
        return rows.repartitionById(self.parts, F.col("part")).groupBy("part")


def together(payloads: list[bytes], columns: int) -> list[np.ndarray]:
    """Columns of all payloads, end to end."""
    found = [unpack(p, columns) for p in payloads]
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=U64) for i in range(columns)]


def word_hash(word: str) -> int:
    """64 bits of a word with A-Z in lower case."""
    lower = word.lower() if word.isascii() else word.translate(ASCII_LOWER)
    return xxhash.xxh3_64_intdigest(lower.encode("utf-8", "surrogatepass"))


class WordHashes(dict):
    """64-bit hashes of words with A-Z in lower case; remembers a bounded number of them."""

    def __missing__(self, word: str) -> int:
        value = word_hash(word)
        if len(word) <= LONG:
            if len(self) > MEMORY:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 texts, with A-Z in lower case, and where each text's begin (and the last one's end).

    All words at once, eight bytes at a time; very long ones go by xxhash. Not the numbers of WordHashes.
    """
    joined = b" ".join(texts).lower() + b" " * 9
    data = np.frombuffer(joined, np.uint8)
    space = SPACES[data]
    turns = np.flatnonzero(np.diff(space, prepend=True))
    low, length = turns[::2], turns[1::2] - turns[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", joined, 0, (1,))
    h = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    open_ = np.flatnonzero(length <= LONG)
    for done in range(0, LONG, 8):
        open_ = open_[length[open_] > done]
        if not len(open_):
            break
        h[open_] = mix(h[open_] ^ (eight[low[open_] + done] & LOW_BYTES[np.minimum(length[open_] - done, 8)]))
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(joined[low[i] : low[i] + length[i]])
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return h, np.append(np.searchsorted(low, np.cumsum(sizes) - sizes), len(low))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` words; of the whole, if it is shorter."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    total = np.full(n, min(len(hashes), width), dtype=U64)
    for i in range(min(width, len(hashes))):
        total = total * U64(0x9E3779B97F4A7C15 | 1) + hashes[i : i + n]
    return mix(total)
