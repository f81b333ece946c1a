"""Language identification by words, backing off to character n-grams.

A known word adds, for each language, the logarithm of its frequency there. An unseen word is scored
by the n-grams of the highest order of which it holds a known one, from 4 characters down to 1, as the
mean of their log frequencies; word ends count as characters. The sum over a text's words decides,
and the score is the winner's share by Bayes' rule with equal priors.

The model is fitted on a bounded sample of labelled rows: `sample` documents in all, drawn by a hash of the
id, an even part for each language and what a language hasn't got for the others. So no language is missing for being
rare. It keeps every word and n-gram that occurs twice or more in the sample (`least`), whatever the language and
length; the sample bounds them, so the model is small enough to broadcast whatever the corpus. Every text is scored as a
whole, where it is read; there is no shuffle of texts.

Null text and text without a letter give und and score 0. If nothing of a text is known, the language
with most training words is given, with an equal share as score. Without training rows every text is und with
score 0. Equal rows get equal answers; ties go to the language first by code point. Of an input only
doc_id, text and lang are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import worker_memory

SAMPLE = 10_000
#: Units that occur less often in the sample tell little and are most of all.
LEAST = 2
ORDERS = (4, 3, 2, 1)
#: Longer words are scored each time, not remembered.
LONGEST = 40
SMOOTHING = 0.5
MEMORY = 500_000
#: Takes some numbers for letters too, as fractions and superscripts.
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    lower = (text or "").lower()
    words = LETTERS.findall(lower)
    if lower.isascii() or all(map(str.isalpha, words)):
        return words
    return LETTERS.findall("".join([c if c.isalpha() else " " for c in lower]))


class Units:
    """Words or n-grams with a row of log frequencies each."""

    def __init__(self, units: list[str], logs: np.ndarray):
        self.at, self.logs = {u: i for i, u in enumerate(units)}, logs

    def __contains__(self, unit: str) -> bool:
        return unit in self.at

    def __getitem__(self, unit: str) -> np.ndarray:
        return self.logs[self.at[unit]]


def shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """What part of each language's rows is drawn: all of the rare ones, and of the others equally many."""
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(1.0, left / (len(counts) - k) / max(1, n))
        left -= min(n, left // (len(counts) - k))
    return out


def _counted(counts: DataFrame, unit: str, langs: list[str], least: int) -> tuple[list[str], np.ndarray]:
    """The units that occur often enough, in order, and their counts by language. counts: lang, the unit and n, of the sample."""
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    found = counts.groupBy(unit).agg(F.sum("n").alias("total"), *by_lang).filter(F.col("total") >= least).drop("total").toArrow().sort_by(unit)
    return found.column(unit).to_pylist(), np.stack([found.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(float) if langs else np.zeros((0, 0))


def learn(labelled: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> dict:
    """The model as arrays: languages, words and n-grams with a row of log frequencies each.

    labelled: doc_id, text and a non-null lang.
    """
    share = shares({r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}, sample)
    if any(s < 1 for s in share.values()):
        below = F.element_at(F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(int(s * (1 << 30))))]), F.col("lang"))
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < below)
    words = labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    words = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).cache()
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    padded = F.concat(F.lit("\u0002"), "word", F.lit("\u0003"))
    grams = F.flatten(F.array(*[F.expr(f"CASE WHEN length(p) >= {k} THEN transform(sequence(1, length(p) - {k - 1}), i -> substr(p, i, {k})) ELSE array() END") for k in ORDERS]))
    spelled = words.withColumn("p", padded).select("lang", "n", F.explode(grams).alias("gram"))
    spelled = spelled.groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def logs(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log(counts + SMOOTHING) - np.log(whole + SMOOTHING * max(1, len(counts)))

    known, counts = _counted(words, "word", langs, least)
    pieces, by_gram = _counted(spelled, "gram", langs, least)
    words.unpersist()
    frequencies = np.zeros_like(by_gram)
    sizes = np.array([len(g) for g in pieces])
    for k in ORDERS:
        frequencies[sizes == k] = logs(by_gram[sizes == k], by_gram[sizes == k].sum(axis=0))
    most = min(langs, key=lambda x: (-totals[x], x), default=None)
    return {"langs": langs, "words": known, "logs": logs(counts, np.array([float(totals[x]) for x in langs])), "grams": Units(pieces, frequencies), "most": most}


class Scorer:
    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.start()

    def start(self) -> None:
        self.at = {w: i for i, w in enumerate(self.model["words"])}
        self.table = np.vstack([self.model["logs"], np.zeros((1024, len(self.langs)))])
        self.used = len(self.at)

    def backoff(self, word: str) -> np.ndarray:
        grams, padded = self.model["grams"], f"\x02{word}\x03"
        for k in ORDERS:
            hits = [at for i in range(len(padded) - k + 1) if (at := grams.at.get(padded[i : i + k])) is not None]
            if hits:
                return grams.logs[hits].mean(axis=0)
        return np.zeros(len(self.langs))

    def remember(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.backoff(word)
        self.at[word] = self.used
        self.used += 1
        return self.at[word]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters(text)
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return "und", 0.0
        if self.used > MEMORY + len(self.model["words"]):
            self.start()
        at = self.at
        try:
            rows = [at[w] for w in words]
            total = self.table[rows].sum(axis=0)
        except KeyError:
            rest = [w for w in words if len(w) > LONGEST and w not in at]
            rows = [at[w] if w in at else self.remember(w) for w in words if len(w) <= LONGEST or w in at]
            total = self.table[rows].sum(axis=0) + sum((self.backoff(w) for w in rest), np.zeros(len(self.langs)))
        best = int(total.argmax())
        if not total.any():
            return self.model["most"], 1 / len(self.langs)
        return self.langs[best], 1 / float(np.exp(np.clip(total - total[best], -700, 0)).sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of each row; reads doc_id and text alone."""
    plain = model | {"grams": (list(model["grams"].at), model["grams"].logs)}  # as workers needn't have this module
    shared, key = docs.sparkSession.sparkContext.broadcast(plain), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_memory("language", key, lambda: Scorer(shared.value | {"grams": Units(*shared.value["grams"])}))
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
