"""Token counts under a unigram vocabulary, shared between words through a trie.

The distinct pre-tokens of a batch are visited in sorted order, which is the pre-order of the trie that
they span. A node's forward score is the best score of any segmentation of the path to it; it is
computed once and serves all pre-tokens below. All nodes of one depth are computed at a time, as arrays: an automaton of the
pieces (Aho and Corasick) says which of them end at a node. What a pre-token's last node holds is its number of pieces,
so a text costs one look-up a word.

A pre-token is a word with a mark in front, as vocabularies of this kind have it. The vocabulary orders its pieces but has
no frequencies. They are learned from the corpus by one step of expectation and maximisation with best segmentations: all
words of all documents are cut under scores by rank (Zipf's law), the pieces are counted, and a piece's score is the
logarithm of its share. A character that no piece has costs one piece for each of its UTF-8 bytes. Equal scores go to the longer last piece.

Null or empty text has no tokens. Equal rows get equal counts. Only doc_id and text are read; an empty table gives an
empty result. Very long words are scored like others, character by character and not by depth.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import tidy_batches, worker_memory

MARK = "▁"
#: Bytes of text whose words are made distinct together, and characters of distinct words whose trie is in memory.
TEXTS = 32 << 20
CHARACTERS = 1 << 20
#: Longer words are scored character by character.
LONG = 200


def vocabulary(path: str) -> dict[str, float]:
    """Piece -> score, of a sentencepiece file without its control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ordered = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: -math.log(rank) for rank, p in enumerate(ordered, 2)}


class PrefixScores:
    def __init__(self, scores: dict[str, float]):
        self.byte = min(scores.values(), default=0.0) - 10
        self.ends: dict = {}  # pieces from their last character backwards; a score under ""
        for piece, score in scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.entered = 0

    def _visited(self, words: Iterable[str]) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """Each word, in sorted order, with the path to it; and for each node of the path its pieces and where its last one begins."""
        path: list[str] = []
        best, pieces, begins = [0.0], [0], [0]
        for word in sorted(words):
            text = MARK + word
            same = 0
            for a, b in zip(path, text, strict=False):
                if a != b:
                    break
                same += 1
            del path[same:], best[same + 1 :], pieces[same + 1 :], begins[same + 1 :]
            for c in text[same:]:
                path.append(c)
                self.entered += 1
                width = len(c.encode("utf-8", "surrogatepass"))
                top, n, begin = best[-1] + self.byte * width, pieces[-1] + width, -1
                node, at = self.ends, len(path)
                while at:
                    at -= 1
                    node = node.get(path[at])
                    if node is None:
                        break
                    score = node.get("")
                    if score is not None and best[at] + score >= top:
                        top, n, begin = best[at] + score, pieces[at] + 1, at
                best.append(top)
                pieces.append(n)
                begins.append(begin)
            yield word, path, pieces, begins

    def counts(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Each word, in sorted order, and its number of pieces."""
        for word, _, pieces, _ in self._visited(words):
            yield word, pieces[-1]

    def cut(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each word, in sorted order, and its pieces; characters that no piece has are left out."""
        for word, path, _, begins in self._visited(words):
            found, at = [], len(path)
            while at:
                if begins[at] >= 0:
                    found.append("".join(path[begins[at] : at]))
                at = begins[at] if begins[at] >= 0 else at - 1
            yield word, found


class Automaton:
    """Where pieces end on any path: a state for every prefix of a piece. State 0 is the empty prefix, and no piece's end."""

    def __init__(self, pieces: Iterable[str]):
        children: list[dict[str, int]] = [{}]
        self.ends: dict[str, int] = {}  # piece -> state
        for piece in pieces:
            state = 0
            for c in piece:
                to = children[state].get(c)
                if to is None:
                    to = children[state][c] = len(children)
                    children.append({})
                state = to
            if state:
                self.ends[piece] = state
        n = len(children)
        fail, longest, shorter = [0] * n, [0] * n, [0] * n
        self.length = np.zeros(n, np.int64)
        for piece, state in self.ends.items():
            longest[state] = state
            self.length[state] = len(piece)
        queue = [0]
        for state in queue:  # by depth, so the state behind another one is done before it
            for c, to in children[state].items():
                queue.append(to)
                back = fail[state]
                while back and c not in children[back]:
                    back = fail[back]
                fail[to] = children[back].get(c, 0) if state else 0
                shorter[to] = longest[fail[to]]
                longest[to] = longest[to] or shorter[to]
        #: The state to go on from if one has no such character; the longest piece that ends at a state; the next shorter one that ends where a piece does.
        self.fail, self.longest, self.shorter = np.array(fail), np.array(longest), np.array(shorter)
        edges = sorted((state << 21 | ord(c), to) for state, of in enumerate(children) for c, to in of.items())
        self.keys, self.targets = np.array([*(k for k, _ in edges), 1 << 62]), np.array([*(to for _, to in edges), 0])

    def after(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The state that each character leads to."""
        states, out, left = states.copy(), np.zeros(len(states), np.int64), np.arange(len(states))
        while len(left):
            key = states[left] << 21 | chars[left]
            at = np.searchsorted(self.keys, key)
            found = self.keys[at] == key
            out[left[found]] = self.targets[at[found]]
            left = left[~found & (states[left] > 0)]
            states[left] = self.fail[states[left]]
        return out


class DepthScores:
    """Pieces of sorted distinct words; the trie that they span is computed depth by depth. Gives what PrefixScores gives."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte = min(scores.values(), default=0.0) - 10
        self.automaton = Automaton(scores)
        self.score = np.zeros(len(self.automaton.fail))
        for piece, state in self.automaton.ends.items():
            self.score[state] = scores[piece]
        self.ring = int(self.automaton.length.max()) + 1
        self.plain: PrefixScores | None = None
        self.entered = 0

    def _by_length(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Places of words that aren't empty: of those of usual length in parts of bounded size, and of the long ones."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        usual = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        part = np.cumsum(sizes[usual], dtype=np.int64) // CHARACTERS
        return [p for p in np.split(usual, np.flatnonzero(np.diff(part)) + 1) if len(p)], np.flatnonzero(sizes > LONG)

    def _long(self) -> PrefixScores:
        if self.plain is None:
            self.plain = PrefixScores(self.scores)
        return self.plain

    def _trie(self, words: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each depth's nodes begin, each word's last node, and for each node its pieces, the end of its last one (0: bytes) and the node where that begins."""
        sizes = pc.utf8_length(words).to_numpy() + 1
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), MARK)[0].as_py()
        text = np.frombuffer((MARK + joined).encode("utf-32-le"), np.uint32).astype(np.int64)
        most = len(text) + 1
        best, state, pieces, last, begins = np.zeros(most), *(np.zeros(most, np.int64) for _ in range(4))
        path = np.zeros((self.ring, len(words)), np.int64)  # a word's nodes at the last depths
        alive, levels = np.arange(len(words)), [1]
        for depth in range(1, int(sizes.max()) + 1):
            alive = alive[sizes[alive] >= depth]
            char, above = text[starts[alive] + depth - 1], path[(depth - 1) % self.ring, alive]
            new = np.ones(len(alive), bool)
            new[1:] = (above[1:] != above[:-1]) | (char[1:] != char[:-1])
            path[depth % self.ring, alive] = levels[-1] - 1 + np.cumsum(new)
            word, char, above = alive[new], char[new], above[new]
            here = slice(levels[-1], levels[-1] + len(word))
            levels.append(here.stop)
            state[here] = self.automaton.after(state[above], char)
            top, begin, end = np.full(len(word), -np.inf), above.copy(), np.zeros(len(word), np.int64)
            left, tried = np.arange(len(word)), self.automaton.longest[state[here]]
            while True:  # from the longest piece that ends here to the shortest
                left, tried = left[tried > 0], tried[tried > 0]
                if not len(left):
                    break
                start = path[(depth - self.automaton.length[tried]) % self.ring, word[left]]
                value = best[start] + self.score[tried]
                better = value > top[left]
                at = left[better]
                top[at], begin[at], end[at] = value[better], start[better], tried[better]
                tried = self.automaton.shorter[tried]
            width = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
            value = best[above] + self.byte * width
            none = value > top
            top[none], begin[none], end[none] = value[none], above[none], 0
            best[here], begins[here], last[here] = top, begin, end
            pieces[here] = pieces[begin] + np.where(end > 0, 1, width)
        self.entered += levels[-1] - 1
        n = levels[-1]
        return levels, path[sizes % self.ring, np.arange(len(words))], pieces[:n], last[:n], begins[:n]

    def counts(self, words: pa.Array) -> np.ndarray:
        """The number of pieces of each word; none of an empty one."""
        out = np.zeros(len(words), np.int64)
        parts, long = self._by_length(words)
        for places in parts:
            _, at, pieces, _, _ = self._trie(words.take(pa.array(places)))
            out[places] = pieces[at]
        if len(long):
            found = dict(self._long().counts(texts := words.take(pa.array(long)).to_pylist()))
            out[long] = [found[w] for w in texts]
        return out

    def used(self, words: pa.Array, n: np.ndarray) -> np.ndarray:
        """How often pieces are used, by the state where they end, if each word occurs n times. What a node's words use passes to where its last piece begins."""
        out = np.zeros(len(self.score), np.int64)
        parts, long = self._by_length(words)
        for places in parts:
            levels, at, _, last, begins = self._trie(words.take(pa.array(places)))
            times = np.zeros(levels[-1], np.int64)
            times[at] = n[places]
            for low, high in zip(levels[-2::-1], levels[:0:-1], strict=True):
                np.add.at(times, begins[low:high], times[low:high])
            np.add.at(out, last, times)
        if len(long):
            times = dict(zip(texts := words.take(pa.array(long)).to_pylist(), n[long], strict=True))
            for word, found in self._long().cut(texts):
                for piece in found:
                    out[self.automaton.ends[piece]] += times[word]
        out[0] = 0
        return out


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of batch in their order, so many at a time that their texts have at most TEXTS bytes, or one."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and held + size > TEXTS:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield batch.slice(low)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words in sorted order, the place there of each word as it comes, and where each text's words begin and end.

    One empty word may be among them: splitting leaves it where a text begins or ends with white space.
    """
    lists = pc.ascii_split_whitespace(texts)  # at what WORD leaves out
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()], bounds


def learn(docs: DataFrame, scores: dict[str, float], smoothing: float = 0.5) -> dict[str, float]:
    """The vocabulary with scores by how often the best segmentations of all words of docs use each piece."""
    shared, key = docs.sparkSession.sparkContext.broadcast(scores), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_memory("token_counts", key, lambda: DepthScores(shared.value))
        used = np.zeros(len(trie.score), np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                words, places, _ = _words(part.column(0))
                used += trie.used(words, np.bincount(places, minlength=len(words)))
        found = {piece: n for piece, state in trie.automaton.ends.items() if (n := int(used[state]))}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])

    used = docs.select("text").mapInArrow(tidy_batches(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # pieces at most
    counts = {r["piece"]: r["n"] for r in used}
    whole = math.log(sum(counts.values()) + smoothing * len(scores))
    return {p: math.log(counts.get(p, 0) + smoothing) - whole for p in scores}


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_words and n_tokens of each row. scores: the vocabulary, which is small, sent to every worker."""
    shared, key = docs.sparkSession.sparkContext.broadcast(scores), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_memory("token_counts", key, lambda: DepthScores(shared.value))
        for batch in batches:
            for part in _parts(batch, 1):
                words, places, bounds = _words(part.column(1))
                tokens, one = trie.counts(words), pc.utf8_length(words).to_numpy(zero_copy_only=False) > 0
                n_words, n_tokens = (np.diff(np.concatenate([[0], np.cumsum(n[places], dtype=np.int64)])[bounds]) for n in (one, tokens))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy_batches(run), "doc_id long, n_words long, n_tokens long")
