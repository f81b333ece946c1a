"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped for scoring.

1. Words of the training rows are counted by hash range. Every range becomes a sorted array of hashes, with counts, in
   a file in the shared folder; a word's number is its place in all ranges.
2. Pairs of neighbours are counted as exact 64-bit keys of two numbers, by range of a bijective hash of
   the key, so that a frequent first word doesn't meet in one task; every range becomes a sorted hash array.
   With order 3 triples are counted instead, as a pair's key and a number, by range of a 64-bit hash of both; every range
   becomes a sorted hash array, and gives the pairs: how many different words precede one, and the total and counts of counts after it.
3. From the pairs: how many different words precede a word, and the total and counts of counts after it.
4. Workers map the files and score whole texts: sorted look-ups of a block's pairs and triples.

log10 p sums over a text's words and one end. A first word follows order - 1 start marks. The discounts are
those of Chen and Goodman (1999), for the longest from their counts and for shorter ones from the numbers of their
predecessors; below words stands the uniform 1 / (V + 1), whose extra place is for unseen words.

All files grow with the corpus, none is broadcast or held as a whole.
Null text is scored as empty. No training rows: every probability is 1. Rows without an id are scored and not learned
from. Equal rows count as often as they stand. Only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORDS, hash_ranges, materialise, of_known_size, shared_dir, worker_memory
from tessella.llm.exchange import BLOCK, U64, Ranges, WordHashes, dealt, mix, part_of, runs, together, word_hash

END = 0xE1D0_0000_0000_0001  # a hash for the end of a text
SCORED = 1_000_000  # tokens that are looked up together
#: Bytes of a table in a range: a range is two files, and its counts take less room than texts.
RANGE = 32 << 20
ORDER = 2
MAPS = 4000  # ranges that a worker has mapped; a system allows some ten thousand maps
ROWS = "part int, about boolean, payload binary"


def _folder(docs: DataFrame) -> str:
    """A folder of its own in the shared one, as a path of the file system: maps need that."""
    where = urllib.parse.urlparse(shared_dir(docs.sparkSession))
    if where.scheme not in ("", "file"):
        raise ValueError("memory-mapped models need a shared folder that is mounted: spark.checkpoint.dir is " + where.geturl())
    path = f"{where.path}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _save(path: str, array: np.ndarray) -> None:
    """As a whole or not at all: a task may run twice."""
    part = f"{path}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, path)


def _map(path: str, dtype: type) -> np.ndarray:
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)


class SortedHashes:
    """Sorted hash arrays in files, one for each hash range, with a count for each hash."""

    def __init__(self, folder: str, name: str, sizes: list[int], more: tuple[str, ...] = ()):
        self.folder, self.name, self.parts, self.more = folder, name, len(sizes), more
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.open: OrderedDict[int, tuple[np.ndarray, ...]] = OrderedDict()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place among all hashes (-1: none), count (0: none) and further numbers (0: none) of ascending hashes."""
        places, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        further = [np.zeros(len(hashes)) for _ in self.more]
        for p, a, b in runs(part_of(hashes, self.parts)):
            if self.starts[p] == self.starts[p + 1]:
                continue
            if p not in self.open:
                self.open[p] = (_map(f"{self.folder}/{self.name}-{p}", U64), _map(f"{self.folder}/{self.name}-{p}-n", np.uint32), *[_map(f"{self.folder}/{self.name}-{p}-{x}", np.float64) for x in self.more])
                if len(self.open) > MAPS:
                    self.open.popitem(last=False)
            keys, n, *others = self.open[p]
            at = np.searchsorted(keys, hashes[a:b])
            at[at == len(keys)] = 0
            hit = keys[at] == hashes[a:b]
            places[a:b] = np.where(hit, at + self.starts[p], -1)
            counts[a:b] = np.where(hit, n[at], 0)
            for values, other in zip(further, others, strict=True):
                values[a:b] = np.where(hit, other[at], 0)
        return places, counts, *further

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """As `find`, of hashes in any order."""
        order = np.argsort(hashes)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return tuple(x[back] for x in self.find(hashes[order]))


class WordNumbers(dict):
    """Words as numbers; -1 for unseen ones.

    Texts come in groups. A word that is new gets a place among the group's new words at first, so a text is
    gone through once; the numbers of all of them are looked up together.
    """

    def __init__(self, vocabulary: SortedHashes):
        self.vocabulary = vocabulary
        self.end = int(vocabulary.find(np.array([END], U64))[0][0])

    def __missing__(self, word: str) -> int:
        """For now the word's place among the new ones, as -2 and less."""
        self.new.append(word)
        self[word] = n = -1 - len(self.new)
        return n

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each text's numbers and the end's."""
        if len(self) > 1_000_000:
            self.clear()
        self.new: list[str] = []
        out = [np.fromiter(map(self.__getitem__, [*words, ""]), dtype=np.int64, count=len(words) + 1) for words in texts]
        if self.new:
            hashes = np.fromiter(map(word_hash, self.new), dtype=U64, count=len(self.new))
            order = np.argsort(hashes)
            places = np.empty(len(order), np.int64)
            places[order] = self.vocabulary.find(hashes[order])[0]
            self.update(zip(self.new, places.tolist(), strict=True))
            for numbers in out:
                late = numbers < -1
                numbers[late] = places[-2 - numbers[late]]
            for word in self.new:
                if len(word) > 200:
                    del self[word]
        self[""] = self.end  # no word is empty
        for numbers in out:
            numbers[-1] = self.end
        return out


def _rows(rows: list[tuple[int, bytes]], about: list[tuple[int, bytes]] = ()) -> pa.RecordBatch:
    """Rows of counts, and of what is about contexts."""
    part, payload = zip(*rows, *about, strict=True) if rows or about else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([False] * len(rows) + [True] * len(about), pa.bool_()), pa.array(payload, pa.binary())], names=["part", "about", "payload"])


def triple_hash(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(pair) + (word + U64(1)) * U64(0x9E3779B97F4A7C15))


def _again(ranges: Ranges, columns: int, by_mix: bool):
    """The second cut of many ranges: keys with their counts, summed, and what is about contexts."""

    def again(part: int, about: bool, payloads: list[bytes]) -> Iterator[tuple[int, bool, bytes]]:
        keys, *sums = _sums_by(*together(payloads, 5 if about else columns))
        dealing = _by_mix(keys, sums, ranges.parts) if by_mix else dealt(keys, sums, ranges.parts)
        yield from ((p, about, data) for p, data in dealing)

    return again


def _triples_again(ranges: Ranges):
    """As `_again`, of triples."""

    def again(part: int, about: bool, payloads: list[bytes]) -> Iterator[tuple[int, bool, bytes]]:
        yield from ((p, about, data) for p, data in _triples_dealt(*_summed_triples(*together(payloads, 3)), ranges.parts))

    return again


def _by_mix(keys: np.ndarray, columns: list[np.ndarray], parts: int) -> list[tuple[int, bytes]]:
    """Ascending keys by range of their bijective hash, and ascending within it."""
    to = part_of(mix(keys), parts).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(to, kind="stable")
    return [(p, data) for p, a, b in runs(to[order]) for _, data in dealt(keys[order[a:b]], [c[order[a:b]] for c in columns], 1)]


def _groups(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Some rows and their texts' words; the text is the last column."""
    for batch in batches:
        for at in range(0, len(batch), size):
            rows = batch.slice(at, size)
            yield rows, [WORDS.findall(text.as_py() or "") for text in rows.column(rows.num_columns - 1)]


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their number or the sum of their counts."""
    if counts is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(U64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _sums_by(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of their columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return [keys[starts], *[np.add.reduceat(c[order], starts).astype(U64) if len(keys) else c for c in columns]]


def _summed_triples(pair: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct triples by ascending hash: hash, pair, word and the sum of their counts."""
    hashes = triple_hash(pair, word)
    order = np.argsort(hashes)
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    at = order[starts]
    return hashes[starts], pair[at], word[at], np.add.reduceat(counts[order], starts) if len(hashes) else counts


def _triples_dealt(hashes: np.ndarray, pair: np.ndarray, word: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """By range of the hash, and in a range by pair, which takes fewer bytes."""
    for p, a, b in runs(part_of(hashes, parts)):
        order = a + np.argsort(pair[a:b])
        yield from ((p, data) for _, data in dealt(pair[order], [word[order], counts[order]], 1))


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held, n = worker_memory("word_hashes", 1, WordHashes), [], 0

        def send() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate(held))
            return _rows(list(dealt(keys, [counts], parts)))

        for _, texts in _groups(batches):
            held += [memory.of(words) for words in texts] + [np.full(len(texts), END, U64)]
            n += sum(map(len, texts)) + len(texts)
            if n >= BLOCK:
                yield send()
                held, n = [], 0
        if held:
            yield send()

    return run


def _keep_words(folder: str):
    def run(block: pa.Table) -> pa.Table:
        p = block.column("part")[0].as_py()
        keys, counts = _summed(*together(block.column("payload").to_pylist(), 2))
        _save(f"{folder}/word-{p}", keys)
        _save(f"{folder}/word-{p}-n", np.minimum(counts, 2**32 - 1).astype(np.uint32))
        return pa.table({"part": pa.array([p], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


def _count_grams(vocabulary: SortedHashes, parts: int, start: int, order: int):
    """Pairs, or triples with order 3, of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, n = worker_memory("numbers", vocabulary.folder, lambda: WordNumbers(vocabulary)), [], 0

        def send() -> pa.RecordBatch:
            keys = np.concatenate(held)
            if order == 3:
                pair, word = keys.reshape(-1, 2).T
                return _rows(list(_triples_dealt(*_summed_triples(pair, word, np.ones(len(pair), U64)), parts)))
            keys, counts = _summed(keys)
            return _rows(_by_mix(keys, [counts], parts))

        for _, texts in _groups(batches):
            for last in numbers.of(texts):
                last = last.astype(U64)
                padded = np.concatenate([np.full(order - 1, start, U64), last])
                pair = (padded[:-1] << U64(32)) | padded[1:]
                held.append(np.stack([pair[:-1], last], axis=1).ravel() if order == 3 else pair)
                n += len(last)
            if n >= BLOCK:
                yield send()
                held, n = [], 0
        if held:
            yield send()

    return run


def _by_number(numbers: np.ndarray, columns: list[np.ndarray], starts: np.ndarray) -> list[tuple[int, bytes]]:
    """By the range that a number belongs to; the start mark goes with the last."""
    cuts = np.searchsorted(numbers, starts.astype(U64))
    cuts[-1] = len(numbers)
    return [(p, data) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b for _, data in dealt(numbers[a:b], [c[a:b] for c in columns], 1)]


def _after(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of ascending keys of contexts: distinct ones, and the total and the numbers of counts of 1, 2, and 3 and more after them."""
    distinct, at = np.unique(keys, return_index=True)
    return distinct, [np.add.reduceat(x, at).astype(U64) for x in (counts, counts == 1, counts == 2, counts >= 3)] if len(keys) else [counts] * 4


def _keep_triples(folder: str, parts: int):
    """A range of triples -> its file; counts of counts (part -1 - range); pairs with the number of their predecessors, and what is after them."""

    def run(block: pa.Table) -> pa.Table:
        p = block.column("part")[0].as_py()
        hashes, pair, word, counts = _summed_triples(*together(block.column("payload").to_pylist(), 3))
        _save(f"{folder}/triple-{p}", hashes)
        _save(f"{folder}/triple-{p}-n", np.minimum(counts, 2**32 - 1).astype(np.uint32))
        of_counts = np.array([len(hashes), *[(counts == k).sum() for k in (1, 2, 3, 4)]], np.int64).tobytes()
        order = np.argsort(pair)
        contexts, sums = _after(pair[order], counts[order])
        pairs, preceded = _summed((pair << U64(32)) | word)
        return pa.Table.from_batches([_rows([(-1 - p, of_counts), *_by_mix(pairs, [preceded], parts)], _by_mix(contexts, sums, parts))])

    return run


def _left(d: tuple[float, float, float], total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
    """The mass that contexts leave to shorter ones; 1 where nothing was seen after them."""
    return np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)


def _keep_pairs(folder: str, starts: np.ndarray, d3: tuple[float, float, float] | None):
    """A range of pairs -> its files; counts of counts (part -1 - range); and sums by first and by second word.

    d3: with order 3, which has pairs as contexts. One of two start marks is preceded by nothing and counts as no pair.
    """

    def run(block: pa.Table) -> pa.Table:
        p = block.column("part")[0].as_py()
        payloads: tuple[list[bytes], list[bytes]] = ([], [])
        for about, payload in zip(block.column("about").to_pylist(), block.column("payload").to_pylist(), strict=True):
            payloads[about].append(payload)
        keys, counts = _summed(*together(payloads[False], 2))
        stored, n = keys, counts
        if d3 is not None:
            contexts, *sums = _sums_by(*together(payloads[True], 5))
            stored = np.union1d(keys, contexts)
            n = np.zeros(len(stored), U64)
            n[np.searchsorted(stored, keys)] = counts
            after = np.zeros((4, len(stored)))
            after[:, np.searchsorted(stored, contexts)] = np.stack(sums)
        hashes = mix(stored)
        order = np.argsort(hashes)
        _save(f"{folder}/pair-{p}", hashes[order])
        _save(f"{folder}/pair-{p}-n", np.minimum(n[order], 2**32 - 1).astype(np.uint32))
        if d3 is not None:
            _save(f"{folder}/pair-{p}-total", after[0][order])
            _save(f"{folder}/pair-{p}-left", _left(d3, *after)[order])
        first, sums = _after(keys >> U64(32), counts)
        second, preceded = _summed(keys & U64(2**32 - 1))
        zero = [np.zeros(len(second), U64)] * 4
        both = [np.concatenate([first, second]), *[np.concatenate([s, z]) for s, z in zip(sums, zero, strict=True)], np.concatenate([np.zeros(len(first), U64), preceded])]
        order = np.argsort(both[0], kind="stable")
        rows = _by_number(both[0][order], [c[order] for c in both[1:]], starts)
        of_counts = np.array([len(stored), *[(counts == k).sum() for k in (1, 2, 3, 4)], len(keys)], np.int64).tobytes()
        return pa.Table.from_batches([_rows([(-1 - p, of_counts), *rows])])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2, and 3 and more; within 0.1 and the count, and as for a lower count where none can be told."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.1), k) for d, k in ((d1, 1), (d2, 2), (d3, 3)))


def _keep_contexts(folder: str, starts: np.ndarray, d: tuple[float, float, float]):
    """A range of words -> totals after a word, mass left to shorter contexts, and predecessors, at the words' places."""

    def run(block: pa.Table) -> pa.Table:
        p = block.column("part")[0].as_py()
        a, b = int(starts[p]), int(starts[p + 1]) + (p == len(starts) - 2)
        keys, total, n1, n2, n3, before = together(block.column("payload").to_pylist(), 6)
        table = np.zeros((5, b - a))
        for row, column in zip(table, (total, n1, n2, n3, before), strict=True):
            np.add.at(row, keys.astype(np.int64) - a, column.astype(float))
        for name, values in (("total", table[0]), ("left", _left(d, *table[:4])), ("before", table[4]), ("count", np.append(_map(f"{folder}/word-{p}-n", np.uint32), np.zeros(int(p == len(starts) - 2))) if starts[p] < starts[p + 1] else np.zeros(b - a))):
            with open(f"{folder}/{name}", "r+b") as f:  # one file for all ranges, each writing its own stretch
                f.seek(8 * a)
                f.write(values.astype(np.float64).tobytes())
        n = [int((table[4] == k).sum()) for k in (1, 2, 3, 4)] + [int((table[4] >= 3).sum())]
        return pa.table({"part": pa.array([p], pa.int32()), "n": pa.array([n], pa.list_(pa.int64()))})

    return run


class Model:
    """What scoring needs; travels to workers as a few numbers and a folder."""

    def __init__(self, folder: str, words: SortedHashes, pairs: SortedHashes, triples: SortedHashes | None, total: int, types: int, d3: tuple | None, d2: tuple, d1: tuple, left: float):
        self.folder, self.words, self.pairs, self.triples, self.total, self.types = folder, words, pairs, triples, total, types
        self.d3, self.d2, self.d1, self.left, self.size = d3, d2, d1, left, int(words.starts[-1])

    def map(self) -> Model:
        if not hasattr(self, "maps"):
            self.numbers = WordNumbers(self.words)
            self.maps = {x: _map(f"{self.folder}/{x}", np.float64) for x in ("total", "left", "before", "count")}
        return self

    def logs(self, zeroth: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of p(second | first), or with order 3 p(second | zeroth first), and the second words' counts in training. -1: unseen."""
        taken = lambda c, d: c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int8)]
        seen, known = second >= 0, first >= 0
        before, counts = np.zeros(len(second)), np.zeros(len(second))
        before[seen], counts[seen] = self.maps["before"][second[seen]], self.maps["count"][second[seen]]
        p = taken(before, self.d1) / max(1, self.types) + self.left / (self.size + 1)
        p[known] *= self.maps["left"][first[known]]
        both = np.flatnonzero(known & seen)
        hashes = mix((first[both].astype(U64) << U64(32)) | second[both].astype(U64))
        order = np.argsort(hashes)
        c = self.pairs.find(hashes[order])[1].astype(float)
        at = both[order]
        p[at] += taken(c, self.d2) / np.maximum(self.maps["total"][first[at]], 1)
        if self.triples is not None:
            at = np.flatnonzero(known & (zeroth >= 0))
            pair = (zeroth[at].astype(U64) << U64(32)) | first[at].astype(U64)
            _, _, total, left = self.pairs.found(mix(pair))
            p[at] *= np.where(total > 0, left, 1.0)
            there = np.flatnonzero((total > 0) & seen[at])
            c = self.triples.found(triple_hash(pair[there], second[at[there]].astype(U64)))[1]
            p[at[there]] += taken(c, self.d3) / total[there]
        return np.log10(p), counts


def _of_counts(kept: DataFrame) -> dict[int, np.ndarray]:
    """By range: stored entries, and how many have a count of 1, 2, 3 and 4."""
    return {-1 - r["part"]: np.frombuffer(r["payload"], np.int64) for r in kept.filter("part < 0").collect()}


def _sizes(of_counts: dict[int, np.ndarray], parts: int) -> list[int]:
    return [int(of_counts[p][0]) if p in of_counts else 0 for p in range(parts)]


def _discounts(of_counts: dict[int, np.ndarray]) -> tuple[float, float, float]:
    return discounts(*(sum(np.stack(list(of_counts.values()))[:, 1:5]).tolist() if of_counts else (0, 0, 0, 0)))


def learn(train: DataFrame, order: int = ORDER, parts: int | None = None, fanout: int | None = None) -> Model:
    """The model of all rows of train (text), of order 2 or 3; its files lie in the shared folder. parts, fanout: of `Ranges`, by default by the table's size."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    texts = of_known_size(train.select("text"), "texts")
    ranges, folder = Ranges(hash_ranges(texts, RANGE // (order - 1)) if parts is None else parts, fanout), _folder(train)
    parts, first = ranges.parts, ranges.first
    counted = ranges.grouped(texts.mapInArrow(_count_words(first), ROWS), _again(ranges, 2, False))
    sizes = counted.applyInArrow(_keep_words(folder), "part int, size long, total long").collect()
    by_part = {r["part"]: r for r in sizes}
    words = SortedHashes(folder, "word", [by_part[p]["size"] if p in by_part else 0 for p in range(parts)])
    start = int(words.starts[-1])
    if start >= 2**32 - 1:
        raise ValueError("more than 2^32 distinct words")
    for name in ("total", "left", "before", "count"):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(8 * (start + 1))
    counted, triples, d3 = texts.mapInArrow(_count_grams(words, first, start, order), ROWS), None, None
    if order == 3:
        counted = materialise(ranges.grouped(counted, _triples_again(ranges)).applyInArrow(_keep_triples(folder, first), ROWS), "pairs")
        of_counts = _of_counts(counted)
        triples, d3 = SortedHashes(folder, "triple", _sizes(of_counts, parts)), _discounts(of_counts)
        counted = counted.filter("part >= 0")
    kept = materialise(ranges.grouped(counted, _again(ranges, 2, True)).applyInArrow(_keep_pairs(folder, words.starts, d3), ROWS), "contexts")
    of_counts = _of_counts(kept)
    pairs, d2 = SortedHashes(folder, "pair", _sizes(of_counts, parts), ("total", "left") if order == 3 else ()), _discounts(of_counts)
    found = kept.filter("part >= 0").groupBy("part").applyInArrow(_keep_contexts(folder, words.starts, d2), "part int, n array<long>").collect()
    n1, n2, n3, n4, many = (sum(r["n"][i] for r in found) for i in range(5))
    d1 = discounts(n1, n2, n3, n4)
    types = sum(int(x[5]) for x in of_counts.values())
    left = (d1[0] * n1 + d1[1] * n2 + d1[2] * many) / types if types else 1.0
    return Model(folder, words, pairs, triples, sum(r["total"] for r in sizes), types, d3, d2, d1, left)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one words) and score (the model) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_memory("kneser_ney", model.folder, model.map)
        ids: list = []
        held: list[np.ndarray] = []
        n = 0

        def scored() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held])
            second = np.concatenate(held)
            first = np.concatenate([[0], second[:-1]])
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            first[at] = m.size if m.total else -1
            zeroth = np.concatenate([[0], first[:-1]])
            zeroth[at] = first[at]
            logs, counts = m.logs(zeroth, first, second)
            base = np.log10((counts + 1) / (m.total + m.size + 1))
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)), pa.array(np.full(len(ids), m.total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for rows, texts in _groups(batches):
            ids += rows.column(0).to_pylist()
            held += m.numbers.of(texts)
            n += sum(map(len, held[-len(texts) :]))
            if n >= SCORED:
                yield scored()
                ids, held, n = [], [], 0
        if ids:
            yield scored()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
