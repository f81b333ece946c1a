"""Removal of byte strings that an earlier document holds too, by suffix arrays.

1. A text's 24-byte strings are hashed, and the least of every 27 neighbours is an anchor: the 50 bytes that
   span those 27 hold the same anchor wherever they stand. Where a text repeats itself every few bytes, equal anchors follow
   each other at one distance; such a run is one entry. Anchors are counted by hash range over all
   documents; those of one document only are done with, and with them nearly all of an ordinary corpus.
   An anchor that a task sees in many documents is known to be shared there: one occurrence is counted, the others go straight home.
2. The other anchors go back to their documents, which send the 76 bytes around each (all 50-byte strings
   with that anchor) to the anchor's hash range. Equal surroundings are sent once by a task.
   Anchors that very many documents have, or that stand in runs, go as their single 50-byte strings: a document range sends
   every distinct one with its smallest document, gets the smallest of all documents back, and keeps the occurrences at home.
   So no task gets all occurrences of anything, and a run of any length costs as much as its period.
3. Of its distinct surroundings a range puts aside those that can't share 50 bytes with other ones, by hashes of the shorter
   stretches that such a string would hold: their strings have the documents that they have. It joins the others to one text and sorts its suffixes in two stages: suffixes smaller
   than their successors are sorted directly, all others are induced by scans over the buckets of first
   bytes. Adjacent common prefixes of 50 bytes and more make groups, each with its smallest document. Single strings likewise.
4. Documents gather the bytes that are covered by strings of a smaller document.

Texts of less than 50 bytes and null text lose nothing. A text equal to that of a smaller document loses all. Rows with
equal ids are one document: they must be equal, and get equal rows. Rows without an id come back untouched and
take no part. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import hash_ranges, of_known_size, tidy, tidy_batches, tidy_pair
from tessella.llm.exchange import U64, Ranges, dealt, mix, pack, pack_ints, part_of, runs, together, unpack, unpack_ints

LENGTH = 50
GRAM = 24
NEAR = LENGTH - GRAM + 1  # 24-byte strings within 50 bytes
AROUND = LENGTH + NEAR - 1  # bytes that hold all 50-byte strings with an anchor
#: Stretches of surroundings around the anchor, of which each 50-byte string in them holds one: STEP + 1 strings begin between two.
STEP = 3
CORES = [(min(a + STEP, NEAR - 1), a + LENGTH) for a in range(0, NEAR, STEP + 1)]
#: Anchors that a task gathers before it sends them; bytes that are hashed at once.
BLOCK, CHUNK = 1_500_000, 1 << 18
#: Slices of a hash range that are sorted one after another, which bounds what is sorted at once.
FINE = 4
#: Entries of an anchor that make it hot: in one block, where several documents have it, and in all. Single strings that are handled at once.
HOT_HERE, HOT, STRINGS = 256, 5000, 200_000
ROWS = "part int, kind int, payload binary"
#: Kinds of rows: by hash range, anchors or surroundings, and questions about strings; by document range, what is done with
#: (shared anchors, stretches), whole copies, occurrences of strings, and answers.
DATA, ASK, WHOLE, OWN, ANSWER, HOME = range(6)
PRIME = 0x9E3779B97F4A7C15
POWERS = np.array([pow(PRIME, LENGTH - 1 - i, 1 << 64) for i in range(LENGTH)], dtype=U64)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    part, kind, payload = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table({"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


def spark_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << U64(r)) | (x >> U64(64 - r))
    h = (U64(42 + 8) + p5) ^ (turn(ids.astype(np.int64, copy=False).view(U64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return h ^ (h >> U64(32))


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(spark_hash(ids).view(np.int64), parts)


def _homed(ids: np.ndarray, columns: list[np.ndarray], parts: int, kind: int, fine: int = 1) -> list[tuple[int, int, bytes]]:
    """By document range; by `fine` of them together."""
    to = _home(ids, parts) // fine
    order = np.lexsort((ids.view(np.int64), to))
    to, ids, columns = to[order], ids[order], [c[order] for c in columns]
    return [(p, kind, pack([ids[a:b], *[c[a:b] for c in columns]])) for p, a, b in runs(to)]


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all 24-byte strings of an array of bytes."""
    power = lambda n: U64(pow(PRIME, n, 1 << 64))
    h = data.astype(U64) + U64(1)
    for n in (1, 2, 4):
        h = h[:-n] * power(n) + h[n:]
    h16 = h[:-8] * power(8) + h[8:]
    return mix(h16[:-8] * power(8) + h[16:])


def _spread(h: np.ndarray) -> np.ndarray:
    """Anchors are the least of their neighbours, so their hashes crowd together; these are even."""
    return mix(h ^ U64(PRIME))


def _slide(h: np.ndarray, best: np.ufunc) -> np.ndarray:
    """best of every NEAR neighbours."""
    for n in (1, 2, 4, 8):
        h = best(h[:-n], h[n:])
    return best(h[: -(NEAR - 16)], h[NEAR - 16 :])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, hash and shape of the anchors; texts have LENGTH bytes at least.

    shape: 64 * n + 2 * d of a run of n equal anchors, each d bytes after the one before; 64 for one that stands alone.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = grams(np.frombuffer(b"".join(texts), np.uint8))
    least = _slide(h, np.minimum)
    at = (ends[:-1, None] - np.arange(1, LENGTH)).ravel()  # 50 bytes from here would end in another text
    least[at] = 0
    around = np.zeros(NEAR - 1, U64)
    found = np.flatnonzero(_slide(np.concatenate([around, least, around]), np.maximum) == h)
    text, h = np.searchsorted(ends, found, "right"), _spread(h[found])
    place = found - (ends - sizes)[text]
    # one anchor goes on with the run of the one before if it is equal, near, and as far from it as that from its own
    step = np.diff(place, prepend=-1)
    equal = np.zeros(len(h), bool)
    equal[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) & (step[1:] <= GRAM)
    if not equal.any():
        return text, place, h, np.full(len(h), 64)
    goes_on = equal.copy()
    goes_on[1:] &= ~equal[:-1] | (step[1:] == step[:-1])
    at = np.flatnonzero(~goes_on)
    n = np.diff(np.append(at, len(h)))
    stride = np.where(n > 1, step[np.minimum(at + 1, len(h) - 1)], 0)
    return text[at], place[at], h[at], 64 * n + 2 * stride


def _known_hot(h: np.ndarray, doc: np.ndarray, place: np.ndarray, shape: np.ndarray) -> tuple[list[np.ndarray], bytes | None]:
    """A block's anchors by hash. Of one that it has HOT_HERE times and more, in several documents, only one entry is left, marked as hot
    whatever the range counts; the others are known to be shared and go home."""
    order = np.argsort(h, kind="stable")
    h, doc, place, shape = h[order], doc[order], place[order], shape[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    counts = np.diff(np.append(at, len(h)))
    here = np.zeros(len(h), bool)
    for a, c in zip(at[counts >= HOT_HERE].tolist(), counts[counts >= HOT_HERE].tolist(), strict=True):
        if doc[a : a + c].min() != doc[a : a + c].max():
            here[a + 1 : a + c] = True
            shape[a] |= U64(1)
    if not here.any():
        return [h, doc, place, shape], None
    return [c[~here] for c in (h, doc, place, shape)], pack([doc[here], place[here] * U64(2) + U64(1), shape[here]], ascending=False)


def _send_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        ids: list[int] = []
        starts: list[int] = []
        seen: dict[bytes, int] = {}
        wholes: list[tuple[int, int]] = []
        n = size = 0

        def hashed() -> int:
            nonlocal texts, ids, starts, size
            if texts:
                text, place, h, shape = anchors(texts)
                held.append((h, np.array(ids, np.int64)[text].view(U64), (place + np.array(starts)[text]).astype(U64), shape.astype(U64)))
                texts, ids, starts, size = [], [], [], 0
                return len(h)
            return 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, seen, wholes
            rows = []
            if held:
                h, doc, place, shape = (np.concatenate(c) for c in zip(*held, strict=True))
                left, known = _known_hot(h, doc, place, shape)
                rows += [(p, DATA, data) for p, data in dealt(left[0], left[1:], parts)]
                if known is not None:
                    rows.append((int(doc[0] % U64(parts)), HOME, known))
            if wholes:
                doc, length = (np.array(c, np.int64).view(U64) for c in zip(*wholes, strict=True))
                rows.append((int(doc[0] % U64(parts)), WHOLE, pack([doc, length], ascending=False)))
            held, n, seen, wholes = [], 0, {}, []
            yield from _table(rows).to_batches()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < LENGTH:
                    continue
                first = seen.setdefault(xxhash.xxh3_128_digest(data), doc)
                if first < doc:
                    wholes.append((doc, len(data)))
                    continue
                for start in range(0, len(data) - LENGTH + 1, CHUNK):  # every 50-byte string in one stretch
                    some = data[start : start + CHUNK + LENGTH - 1]
                    texts.append(some), ids.append(doc), starts.append(start)
                    size += len(some)
                    if size >= CHUNK:
                        n += hashed()
                        if n >= BLOCK:
                            yield from send()
        hashed()
        yield from send()

    return run


def _kinds(block: pa.Table) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {k: [] for k in range(6)}
    for kind, payload in zip(block.column("kind").to_pylist(), block.column("payload").to_pylist(), strict=True):
        found[kind].append(payload)
    return found


def _anchors_again(ranges: Ranges):
    """The second cut of many ranges: anchors by hash, other rows anywhere."""

    def again(part: int, kind: int, payloads: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        if kind != DATA:
            yield from ((part * ranges.fine + i % ranges.fine, kind, p) for i, p in enumerate(payloads))
        else:
            left, known = _known_hot(*together(payloads, 4))
            yield from ((p, DATA, data) for p, data in dealt(left[0], left[1:], ranges.parts))
            if known is not None:
                yield part * ranges.fine, HOME, known

    return again


def _home_again(ranges: Ranges):
    """The second cut of many ranges: what goes to documents."""

    def again(part: int, kind: int, payloads: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        for payload in payloads:
            if kind in (OWN, ANSWER):
                yield struct.unpack_from("<I", payload)[0], kind, payload
            else:
                doc, *rest = unpack(payload, 2 if kind == WHOLE else 3)
                yield from _homed(doc, rest, ranges.parts, kind)

    return again


def _shared(parts: int, fine: int, hot: int):
    """A hash range -> the anchors that several documents have, by document; the lowest bit of the place says hot."""

    def run(block: pa.Table) -> pa.Table:
        found = _kinds(block)
        rows = [r for kind, n in ((WHOLE, 2), (HOME, 3)) for w in found[kind] for r in _homed(*(lambda c: (c[0], c[1:]))(unpack(w, n)), parts, kind, fine)]
        h, doc, place, shape = together(found[DATA], 4)
        order = np.argsort(h)
        h, doc, place, shape = h[order], doc[order].view(np.int64), place[order], shape[order]
        if len(h):
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            counts = np.diff(np.append(starts, len(h)))
            odd = np.maximum.reduceat((shape != U64(64)).astype(np.int8), starts) > 0
            forced = np.maximum.reduceat((shape & U64(1)).astype(np.int8), starts) > 0
            several = np.repeat((np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | forced, counts)
            many = np.repeat((counts > hot) | odd, counts)[several].astype(U64)
            rows += _homed(doc[several].view(U64), [place[several] * U64(2) + many, shape[several]], parts, HOME, fine)
        return _table(rows)

    return run


def _strings(place: np.ndarray, shape: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entry, start and extent of the 50-byte strings with hot anchors.

    A string within a run stands for all equal ones at the run's distance: its extent says how far the last starts after it.
    """
    n, d = shape >> 6, (shape & 63) >> 1
    last = place + (n - 1) * d
    end = last + GRAM  # from place to here the text repeats itself every d bytes
    inner = np.where(n > 1, np.minimum(place + d, end - LENGTH + 1), place)  # of the inner strings those before here are distinct
    inner = np.maximum(inner, place)
    late = np.where(n > 1, np.maximum(place, end - LENGTH + 1), place)
    out = []
    for low, high, extends in ((place - NEAR + 1, place, False), (place, inner, True), (late, last + 1, False)):
        low, high = np.maximum(low, 0), np.minimum(high, size - LENGTH + 1)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(place)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        step = np.maximum(d[which], 1)
        out.append((which, start, (end[which] - LENGTH - start) // step * step if extends else np.zeros(len(start), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _send_surroundings(first: int):
    """Documents and their shared anchors -> the bytes around these and questions about strings, by hash range."""

    def run(docs: pa.Table, block: pa.Table) -> pa.Table:
        found = _kinds(block)
        home = block.column("part")[0].as_py() if len(block) else 0
        # what is at home already only passes through
        rows = [(home % first, WHOLE, w) for w in found[WHOLE]]
        doc, place, shape = (c.view(np.int64) for c in together(found[HOME], 3))
        if not len(doc):
            return _table(rows)
        order = np.argsort(doc, kind="stable")
        doc, place, shape = doc[order], place[order], shape[order]
        wanted = np.unique(doc)
        texts: dict[int, bytes] = {}
        ids = np.array(docs.column("doc_id").to_numpy())
        for i in np.flatnonzero(np.isin(ids, wanted)).tolist():
            texts.setdefault(int(ids[i]), docs.column("text")[i].as_buffer().to_pybytes())
        pad = b"\0" * AROUND
        buffer = np.frombuffer(pad + pad.join(texts[i] for i in wanted.tolist()) + pad, np.uint8)
        sizes = np.array([len(texts[i]) for i in wanted.tolist()])
        offsets = AROUND + np.cumsum(sizes + AROUND) - sizes - AROUND
        texts.clear()
        at = np.searchsorted(wanted, doc)
        hot, place = (place & 1).astype(bool), place >> 1
        # two texts of one id: an anchor may lie beyond the one that is here
        fits = place + GRAM <= sizes[at]
        doc, place, shape, hot, at = (c[fits] for c in (doc, place, shape, hot, at))
        total = 0
        for a in range(0, int(hot.sum()), STRINGS // 64):
            own = np.flatnonzero(hot)[a : a + STRINGS // 64]
            which, start, extent = _strings(place[own], shape[own], sizes[at[own]])
            spot = offsets[at[own[which]]] + start
            order = np.lexsort((-extent, spot))
            order = order[np.concatenate([[True], np.diff(spot[order]) != 0])] if len(order) else order
            which, start, extent, spot = which[order], start[order], extent[order], spot[order]
            for b in range(0, len(spot), STRINGS):
                some = slice(b, b + STRINGS)
                strings, same = _distinct(sliding_window_view(buffer, LENGTH)[spot[some]])
                owner = doc[own[which[some]]]
                least = np.full(len(strings), np.iinfo(np.int64).max)
                np.minimum.at(least, same, owner)
                rows.append((home % first, OWN, struct.pack("<I", home) + pack([same.astype(np.int64).view(U64) + U64(total), owner.view(U64), start[some].view(U64), extent[some].view(U64)], ascending=False)))
                rows += _asked(strings, np.arange(total, total + len(strings)), least, home, first)
                total += len(strings)
        cold = np.flatnonzero(~hot)
        if len(cold):
            doc, place, at = doc[cold], place[cold], at[cold]
            around = np.empty((len(doc), AROUND + 2), np.uint8)
            around[:, :AROUND] = sliding_window_view(buffer, AROUND)[offsets[at] + place - NEAR + 1]
            # the first and the last 50-byte string of the surroundings that is within the text
            around[:, AROUND], around[:, AROUND + 1] = NEAR - 1 - np.minimum(NEAR - 1, place), np.minimum(NEAR - 1, sizes[at] - place - GRAM)
            rows += _dealt_around(around, doc, place, first)
        return _table(rows)

    return run


def _asked(strings: np.ndarray, index: np.ndarray, least: np.ndarray, home: int, parts: int) -> list[tuple[int, int, bytes]]:
    """Questions for the smallest document of each string, by range of its hash."""
    to = part_of(_hash(strings), parts)
    order = np.argsort(to, kind="stable")
    return [(p, ASK, struct.pack("<II", home, b - a) + zstandard.ZstdCompressor(level=1).compress(strings[order[a:b]].tobytes() + pack_ints(index[order[a:b]]) + pack_ints(least[order[a:b]]))) for p, a, b in runs(to[order])]


def _question(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    home, n = struct.unpack_from("<II", payload)
    raw = memoryview(zstandard.ZstdDecompressor().decompress(payload[8:]))
    index, at = unpack_ints(raw, n * LENGTH)
    least, _ = unpack_ints(raw, at)
    return home, np.frombuffer(raw, np.uint8, n * LENGTH).reshape(n, LENGTH), index.view(np.int64), least.view(np.int64)


def _dealt_around(around: np.ndarray, doc: np.ndarray, place: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Surroundings by hash range, in slices: frames of slice, size and the distinct rows with their occurrences."""
    to = part_of(_hash(around[:, NEAR - 1 : LENGTH]), parts * FINE)
    order = np.argsort(to, kind="stable")
    slices: dict[int, list[bytes]] = {}
    for p, a, b in runs(to[order]):
        own = order[a:b]
        distinct, which = _distinct(around[own])
        columns = b"".join(pack_ints(c) for c in (which.astype(np.int64), doc[own], place[own]))
        payload = zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(distinct)) + distinct.tobytes() + columns)
        slices.setdefault(p // FINE, []).append(struct.pack("<BI", p % FINE, len(payload)) + payload)
    return [(p, DATA, b"".join(payloads)) for p, payloads in slices.items()]


def _frames(payload: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(payload):
        which, size = struct.unpack_from("<BI", payload, at)
        yield which, payload[at + 5 : at + 5 + size]
        at += 5 + size


def _occurrences(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct surroundings of a frame; which of them, document and place of each occurrence."""
    raw = memoryview(zstandard.ZstdDecompressor().decompress(payload))
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + n * (AROUND + 2), []
    for _ in range(3):
        values, at = unpack_ints(raw, at)
        out.append(values.view(np.int64))
    return np.frombuffer(raw, np.uint8, n * (AROUND + 2), 4).reshape(n, AROUND + 2), *out


def _surroundings_again(ranges: Ranges):
    def again(part: int, kind: int, payloads: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        for payload in payloads:
            if kind == DATA:
                for _, frame in _frames(payload):
                    table, which, doc, place = _occurrences(frame)
                    yield from _dealt_around(table[which], doc, place, ranges.parts)
            elif kind == ASK:
                home, strings, index, least = _question(payload)
                yield from _asked(strings, index, least, home, ranges.parts)
            else:
                yield part * ranges.fine, kind, payload

    return again


def _hash(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes; some at a time, as numbers take eight times the room."""
    powers = POWERS[LENGTH - rows.shape[1] :]
    return np.concatenate([_spread(mix((rows[a : a + 50_000].astype(U64) + U64(1)) @ powers)) for a in range(0, max(1, len(rows)), 50_000)])


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes, and which of them each row is."""
    cells = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, which = np.unique(cells, return_index=True, return_inverse=True)
    return rows[first], which


def two_stage(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in the order of their first `depth` bytes, and where one has that many in common with the one before.

    text: bytes. Beyond its end a suffix counts as zeros, and shorter than all that go on.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), U64, padded, 0, (1,))
    word = lambda at: eight[at].byteswap()
    # smaller than the successor: by the first byte that differs from the one after it
    step = np.concatenate([np.sign(text[1:].astype(np.int16) - text[:-1]), [-1]]).astype(np.int8)[:n]
    decides = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(decides[::-1])[::-1]] > 0 if n else np.zeros(0, bool)
    # stage 1: those are sorted directly, eight bytes at a time; groups whose members are equal throughout are settled
    direct = np.flatnonzero(smaller).astype(np.int32)
    direct = direct[np.argsort(word(direct), kind="stable")]
    known = word(direct)
    new = np.concatenate([[True], known[1:] != known[:-1]]) if len(direct) else np.zeros(0, bool)
    alike = np.flatnonzero(~new)
    for done in range(8, depth, 8):
        group = np.cumsum(new)
        open_ = np.zeros(len(direct) + 1, bool)
        open_[alike] = open_[alike - 1] = True
        # of these, only groups with a difference ahead
        at = alike
        for ahead in range(done, depth, 8):
            keep = min(8, depth - ahead)
            mask = U64((1 << 64) - (1 << (8 * (8 - keep))))
            at = at[(word(direct[at] + ahead) & mask) == (word(direct[at - 1] + ahead) & mask)]
        differs = np.ones(len(direct) + 1, bool)
        differs[at] = False
        unsettled = np.zeros(int(group[-1]) + 1 if len(group) else 1, bool)
        unsettled[group[alike[differs[alike]]]] = True
        rest = np.flatnonzero(open_[: len(direct)] & unsettled[group]) if len(direct) else alike
        if not len(rest):
            break
        key, own = word(direct[rest] + done), group[rest]
        order = np.lexsort((key, own))
        direct[rest], key, own = direct[rest[order]], key[order], own[order]
        new[rest[1:]] |= (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        alike = rest[~new[rest]]  # settled groups aren't looked at again
    # stage 2: scans of the buckets, in which the others follow from their successors
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    if n:
        waiting[text[-1]].append(np.array([n - 1], np.int32))
    for c in range(256):
        wave, bucket = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int32), []
        waves = [wave]
        while len(wave):  # runs of one byte induce within their bucket
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            wave = before[text[before] == c]
            bucket.append(before[text[before] > c])
            waves.append(wave)
        own = direct[cuts[c] : cuts[c + 1]]
        before = own[own > 0] - 1
        bucket.append(before[~smaller[before] & (text[before] > c)])
        induced = np.concatenate(bucket)
        if len(induced):
            heads = text[induced]
            order = np.argsort(heads, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(heads[order]) != 0]))
            for some in np.split(induced[order], at[1:]):
                waiting[text[some[0]]].append(some)
        out += [*waves, own]
    places = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
    # adjacent common prefixes
    at = np.arange(1, n)
    for ahead in range(0, depth, 8):
        mask = U64((1 << 64) - (1 << (8 * (8 - min(8, depth - ahead)))))
        at = at[(word(places[at] + ahead) & mask) == (word(places[at - 1] + ahead) & mask)]
    same = np.zeros(n, bool)
    same[at] = True
    return places, same


def _repeated(parts: int, fine: int):
    """A hash range's surroundings -> the stretches that a smaller document has too, by document; and answers about strings."""

    def run(block: pa.Table) -> pa.Table:
        kinds = _kinds(block)
        rows = [r for w in kinds[WHOLE] for r in _homed(*(lambda c: (c[0], c[1:]))(unpack(w, 2)), parts, WHOLE, fine)]
        rows += [(struct.unpack_from("<I", own)[0] // fine, OWN, own) for own in kinds[OWN]]
        slices: dict[int, list[bytes]] = {}
        for payload in kinds[DATA]:
            for which, frame in _frames(payload):
                slices.setdefault(which, []).append(frame)
        found = [_stretches(payloads) for payloads in slices.values()]  # one after another, to be small
        if found:
            doc, low, high = merged(*(np.concatenate(c) for c in zip(*found, strict=True)))
            if len(doc):
                rows += _homed(doc.view(U64), [low.astype(U64), high.astype(U64)], parts, HOME, fine)
        if kinds[ASK]:
            asked = [_question(p) for p in kinds[ASK]]
            strings, which = _distinct(np.concatenate([s for _, s, _, _ in asked]))
            smallest = np.full(len(strings), np.iinfo(np.int64).max)
            np.minimum.at(smallest, which, np.concatenate([x for _, _, _, x in asked]))
            smallest = _smallest(strings, smallest)[which]
            cuts = np.cumsum([0, *[len(i) for _, _, i, _ in asked]])
            for (home, _, index, _), a, b in zip(asked, cuts[:-1], cuts[1:], strict=True):
                rows.append((home // fine, ANSWER, struct.pack("<I", home) + pack([index.view(U64), smallest[a:b].view(U64)], ascending=False)))
        return _table(rows)

    return run


def _smallest(strings: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest document of each string, by their order as suffixes of one text."""
    width = LENGTH + 1
    text = np.zeros((len(strings), width), np.uint8)
    text[:, :LENGTH] = strings
    order, same = two_stage(text.ravel())
    whole = order % width == 0
    row, group = order[whole] // width, np.cumsum(~same)[whole]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    out = np.empty(len(strings), np.int64)
    out[row] = np.repeat(np.minimum.reduceat(least[row], starts), np.diff(np.append(starts, len(row))))
    return out


def _alike(around: np.ndarray) -> np.ndarray:
    """Of distinct surroundings, which may share a 50-byte string with another: such a string holds one of CORES, which both then have."""
    cells = np.ascontiguousarray(around)
    out = np.zeros(len(cells), bool)
    for low, high in CORES:
        h = np.zeros(len(cells), U64)
        for at in [*range(low, high - 8, 8), high - 8]:
            h = mix(h ^ np.ndarray((len(cells),), "<u8", cells, at, (cells.shape[1],)))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _stretches(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of what is in a smaller document too."""
    tables, which, docs, places, total = [], [], [], [], 0
    for payload in data:
        table, own, doc, place = _occurrences(payload)
        tables.append(table), which.append(own + total), docs.append(doc), places.append(place)
        total += len(table)
    distinct, again = _distinct(np.concatenate(tables))
    which, doc, place = again[np.concatenate(which)], np.concatenate(docs), np.concatenate(places)
    smallest = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, doc)
    largest = np.full(len(distinct), np.iinfo(np.int64).min)
    np.maximum.at(largest, which, doc)
    # what no other document can share is done with before anything is sorted; strings of surroundings that are like no others have these' documents
    alike = _alike(distinct)
    left = alike | (smallest != largest)
    again, held = np.cumsum(left) - 1, left[which]
    which, doc, place = again[which[held]], doc[held], place[held]
    if not len(which):
        return doc, place, place
    distinct, smallest, alike = distinct[left], smallest[left], alike[left]
    column = np.arange(NEAR)
    valid = (column >= distinct[:, AROUND, None]) & (column <= distinct[:, AROUND + 1, None])
    has = np.where(valid & ~alike[:, None], smallest[:, None], np.iinfo(np.int64).max)
    if alike.any():
        width = AROUND + 1
        text = np.zeros((int(alike.sum()), width), np.uint8)
        text[:, :AROUND] = distinct[alike, :AROUND]
        order, same = two_stage(text.ravel())
        column = order % width
        row = np.flatnonzero(alike)[order // width]
        valid = (column >= distinct[row, AROUND]) & (column <= distinct[row, AROUND + 1])
        group = np.cumsum(~same)[valid]
        row, column = row[valid], column[valid]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        has[row, column] = np.repeat(np.minimum.reduceat(smallest[row], starts), np.diff(np.append(starts, len(group))))
    found = []
    for a in range(0, len(which), 1 << 16):
        b = a + (1 << 16)
        removed = np.zeros((len(which[a:b]), NEAR + 2), np.int8)
        removed[:, 1:-1] = has[which[a:b]] < doc[a:b, None]
        turn = np.diff(removed, axis=1)
        i, low = np.nonzero(turn == 1)
        _, high = np.nonzero(turn == -1)
        found.append((doc[a:b][i], place[a:b][i] - NEAR + 1 + low, place[a:b][i] - NEAR + high + LENGTH))
    return merged(*(np.concatenate(c) for c in zip(*found, strict=True)))


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each document, touching ones joined, in order."""
    if not len(doc):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    lift = np.cumsum(fresh) * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + lift)
    start = fresh | np.concatenate([[True], low[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(start)
    return doc[at], low[at], (reach - lift)[np.append(at[1:], len(doc)) - 1]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _result(docs: pa.Table, block: pa.Table) -> pa.Table:
    kinds = _kinds(block)
    found = [tuple(c.view(np.int64) for c in together(kinds[HOME], 3))]
    doc, length = (c.view(np.int64) for c in together(kinds[WHOLE], 2))
    found.append((doc, np.zeros(len(doc), np.int64), length))
    index, least = (np.concatenate(c).view(np.int64) for c in zip(*[unpack(p[4:], 2) for p in kinds[ANSWER]], strict=True)) if kinds[ANSWER] else (np.zeros(0, np.int64),) * 2
    smallest = np.zeros(len(index), np.int64)
    smallest[index] = least
    for own in kinds[OWN]:
        index, doc, start, extent = (c.view(np.int64) for c in unpack(own[4:], 4))
        out = smallest[index] < doc
        found.append(merged(doc[out], start[out], start[out] + extent[out] + LENGTH))
    doc, low, high = merged(*(np.concatenate(c) for c in zip(*found, strict=True)))
    rows = []
    ids = docs.column("doc_id").to_numpy()
    a, b = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
    for i, (text, x, y) in enumerate(zip(docs.column("text"), a.tolist(), b.tolist(), strict=True)):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        digest, at = hashlib.sha256(), 0
        for s, e in zip(low[x:y].tolist(), high[x:y].tolist(), strict=True):
            digest.update(raw[at:s])
            at = e
        digest.update(raw[at:])
        rows.append((int(ids[i]), len(raw), int((high[x:y] - low[x:y]).sum()), y - x, digest.hexdigest(), low[x:y], high[x:y]))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"), columns, types, strict=True)})


def repeated_spans(docs: DataFrame, hot: int = HOT, parts: int | None = None, fanout: int | None = None) -> DataFrame:
    """RESULT: of every document, what is removed (stretches from starts to ends, in bytes) and the digest of the rest.

    hot: occurrences beyond which an anchor goes by its single strings. parts, fanout: of `Ranges`, by default by the table's size.
    """
    docs = of_known_size(docs.select("doc_id", "text"), "texts")
    ranges = Ranges(hash_ranges(docs) if parts is None else parts, fanout)
    parts, first = ranges.parts, ranges.first
    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    sent = known.mapInArrow(tidy_batches(_send_anchors(first)), ROWS)
    home = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    homed = known.withColumn("part", home).repartitionById(parts, F.col("part")).groupBy("part")
    shared = ranges.grouped(sent, _anchors_again(ranges)).applyInArrow(tidy(_shared(parts, ranges.fine, hot)), ROWS)
    around = homed.cogroup(ranges.grouped(shared, _home_again(ranges))).applyInArrow(tidy_pair(_send_surroundings(first)), ROWS)
    found = ranges.grouped(around, _surroundings_again(ranges)).applyInArrow(tidy(_repeated(parts, ranges.fine)), ROWS)
    out = homed.cogroup(ranges.grouped(found, _home_again(ranges))).applyInArrow(tidy_pair(_result), RESULT)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    none = F.array().cast("array<long>")
    lost = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), none.alias("starts"), none.alias("ends"))
    return out.unionByName(lost)
