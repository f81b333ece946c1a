"""Best-fit packing of documents into token sequences.

Bounded-space online best-fit: a task keeps at most `open_bins` sequences open, in a bitset keyed by
free space. A piece goes to the open sequence that it fills best; when it fits none and all places are
taken, the fullest open sequence closes. Pieces arrive in short windows, longest first, which is how
a bounded number of open sequences comes close to the least possible number.

There is no shuffle: pieces are made and placed where their document was read. Only a count of free
places by size and the pieces of one window are in memory, whatever the size of the input.

Null text counts as empty: one end token. Documents are cut only if longer than a sequence; equal
texts are packed separately; an empty table gives no pieces. Input columns other than the id and the
text aren't read, so clashing names don't matter; a null id is carried along.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORDS, tidy_batches, worker_memory

LENGTH = 2048
#: On 51,282 documents in 8 tasks (tokens for 30,996 sequences) these make 31,018; without windows 31,278, with eight times both 31,000.
OPEN_BINS = 256
WINDOW = 1024
END = b"\0\0\0\0"
#: Pieces whose ids a worker remembers at least, and half the most.
MEMORY = 900_000
#: Longer words aren't remembered.
LONG = 200
GROUP = 500

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Places lengths online in sequences of `size`; at most `open_bins` are open at a time."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def _take(self, room: int) -> int:
        bins = self.free[room]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it."""
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            room, number = self.size, self.made
            self.made += 1
        left = room - length
        if left:
            if self.open >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self._take(fullest)
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - room


class Remembered(dict):
    """Ids by text; keeps the latest `most` to 2 * `most` of them."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def learn(self, new: set[str], make: Callable[[list[str]], list[bytes]]) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        unknown = []
        for text in new:
            value = self.old.get(text)
            if value is None:
                unknown.append(text)
            else:
                self[text] = value
        self.update(zip(unknown, make(unknown), strict=True))

    def forget(self, texts: set[str]) -> None:
        """Long ones, which would fill the memory."""
        for text in texts:
            if len(text) > LONG:
                self.pop(text, None)


class WordTokens:
    """Ids of texts as little-endian bytes.

    The vocabulary never joins text across white space, nor letters with other characters, so ids are kept by piece.
    Texts of plain letters and signs are cut here the way the vocabulary's own pattern does, and their
    pieces go to the library without its normaliser, which would leave them as they are. Other texts are cut into
    words, and what isn't plain of these goes to the library whole.
    """

    #: The vocabulary's own pattern, within the characters of PLAIN; what begins its special tokens and ends its words.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PARTS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
    SPECIAL, WORD_END = "<|", "</w>"

    @classmethod
    def knows(cls, path: str) -> bool:
        """Whether a vocabulary file cuts and ends words as is assumed here."""
        with open(path) as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        return spec.get("normalizer") == cls.NORMALIZER and steps[0].get("pattern") == {"Regex": cls.SPLIT} and spec["model"].get("end_of_word_suffix") == cls.WORD_END and all(t["content"].startswith(cls.SPECIAL) for t in spec["added_tokens"])

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has put a worker on every core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.bare.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for text, i in vocabulary.items() if text.endswith(self.WORD_END)]] = True
        self.parts, self.words = Remembered(memory), Remembered(memory // 2)

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Of pieces; many at a time, told apart by the ids that end a word."""
        out: list[bytes] = []
        lines = [" ".join(parts[i : i + 500]) for i in range(0, len(parts), 500)]
        for e in self.bare.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _made(self, words: list[str]) -> list[bytes]:
        cut = [None if self.SPECIAL in w or not self.PLAIN.fullmatch(w) else self.PARTS.findall(w.lower()) for w in words]
        new = {p for parts in cut if parts for p in parts if p not in self.parts}
        self.parts.learn(new, self._encoded)
        whole = iter(self.tokenizer.encode_batch_fast([w for w, parts in zip(words, cut, strict=True) if parts is None], add_special_tokens=False))
        known = self.parts
        # a piece may have gone to the older half meanwhile
        out = [np.array(next(whole).ids, "<u4").tobytes() if parts is None else b"".join([known[p] if p in known else known.old[p] for p in parts]) for parts in cut]
        known.forget(new)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Texts of plain characters are cut into pieces at once, others into words first."""
        plain = [bool(self.PLAIN_TEXT.fullmatch(t)) and self.SPECIAL not in t for t in texts]
        pieces = self._joined(self.parts, [self.PARTS.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p], self._encoded)
        words = self._joined(self.words, [WORDS.findall(t) for t, p in zip(texts, plain, strict=True) if not p], self._made)
        return [next(pieces) if p else next(words) for p in plain]

    def _joined(self, memory: Remembered, lists: list[list[str]], make: Callable[[list[str]], list[bytes]]) -> Iterator[bytes]:
        """The ids of each list, end to end. All that is new is made together."""
        get, out, gaps, new = memory.get, [], [], set()
        for i, units in enumerate(lists):
            found = list(map(get, units))
            if None in found:
                new.update([u for u, v in zip(units, found, strict=True) if v is None])
                gaps.append((i, units, found))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if gaps:
            memory.learn(new, make)
            for i, units, found in gaps:
                out[i] = b"".join([memory[u] if v is None else v for u, v in zip(units, found, strict=True)])
            memory.forget(new)
        return iter(out)


class PlainTokens:
    """Ids of whole texts by the library alone, for any other vocabulary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _tokens(path: str, memory: int) -> WordTokens | PlainTokens:
    return WordTokens(path, memory) if WordTokens.knows(path) else PlainTokens(path)


def _in_groups(tokens: WordTokens | PlainTokens, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text; a few hundred texts at a time share their unknown words."""
    for at in range(0, len(texts), GROUP):
        yield from tokens.ids([t.as_py() or "" for t in texts.slice(at, GROUP)])


def _pieces(path: str, size: int, open_bins: int, window: int, with_ids: bool, memory: int, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    if with_ids:
        names, types = [*names, "ids"], [*types, pa.binary()]

    def placed(rows: list[tuple], bins: BestFit, base: int) -> pa.RecordBatch:
        rows.sort(key=lambda r: -r[3])  # stable: ties stay in the order read
        columns = [[*r[:5], base + s, o, *r[5:]] for r in rows for s, o in [bins.place(r[3])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_memory("packing", (path, memory), lambda: _tokens(path, memory)) if keep else _tokens(path, memory)
        bins = BestFit(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _in_groups(tokens, batch.column(1)), strict=True):
                ids += END
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                if len(rows) >= window:
                    yield placed(rows, bins, base)
                    rows = []
        if rows:
            yield placed(rows, bins, base)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = LENGTH, open_bins: int = OPEN_BINS, window: int = WINDOW, with_ids: bool = False, memory: int = MEMORY, keep: bool = True) -> DataFrame:
    """One row for each piece, with its sequence and its place there.

    docs: doc_id and text. tokenizer: path of a vocabulary file, the same on every machine.
    memory: how many pieces a worker remembers, and half the most; keep: whether beyond a task. with_ids: adds the piece's ids, little-endian unsigned 32-bit, for `sequences`.
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy_batches(_pieces(tokenizer, size, open_bins, window, with_ids, memory, keep)), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence, end to end, of what pack(..., with_ids=True) gave. A sequence has `size` pieces at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda so_far, x: F.concat(so_far, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
