"""Language identification by error-correcting output codes.

Every language gets a codeword of bits.  One binary classifier per bit looks at hashed byte
n-grams (1 to 3) of the whole text: its weights are smoothed log odds of the n-grams of the
languages whose bit is 1 against those whose bit is 0, from counts over all training documents.
Decoding adds up a logistic loss of every bit's margin, weighted by the bit's reliability on a
bounded sample, and takes the nearest codeword; a small gap to the second one is ambiguous.

The model has ``BITS`` times ``SLOTS`` weights whatever the corpus; counts are summed per task
and then in rounds.  Defined cases: a text that is null or has no letter is ``und`` with score
0; null languages teach nothing; a single language is always chosen; without any training text
every result is ``und``; repeated rows count as often as they come; an empty table gives no
rows; extra columns never matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import added, crc_fold, octets, query, small_batches, table, unit

BITS, SLOTS = 15, 1 << 14
#: Rows on which the reliability of the bits is measured, at most about.
CHECK_ROWS = 4000
#: Most languages a model holds codewords for; more raise an error.
LANGUAGES = 20_000
#: Below this gap between the best two languages a result is ambiguous.
GAP = 0.2
SMOOTH = 0.5
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the hashed byte n-grams of a text, A-Z in lower case, runs of white space as one space."""
    codes = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    two = (codes[:-1] << 8) | codes[1:]
    three = (two[:-1] << 8) | codes[2:]
    mixed = np.concatenate([codes + np.uint32(0x5000000), two + np.uint32(0x3000000), three])
    counts = np.bincount((mixed * np.uint32(2654435761)) >> np.uint32(18), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, counts[slots]


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """``n`` different codewords; of a fixed number of draws, those whose closest pair is furthest apart."""
    if n > LANGUAGES:
        raise ValueError(f"{n} languages; codewords are made for {LANGUAGES} at most")
    width = max(bits, 4 * int(np.ceil(np.log2(n + 1))))
    best, apart = None, -1
    for seed in range(64 if n <= 256 else 1):
        rng = np.random.default_rng(seed)
        words = np.zeros((n, width), bool)
        for b in range(width):  # halves of the languages, so that every bit divides them
            words[rng.permutation(n)[: (n + 1) // 2], b] = True
        some = words[:256]
        closest = min(((some[i] != some[i + 1 :]).sum(1).min() for i in range(len(some) - 1)), default=width)
        if closest > apart:
            best, apart = words, closest
    return best


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray  # language, bit
    weights: np.ndarray  # bit, slot
    prior: np.ndarray
    trust: np.ndarray

    def margins(self, text: bytes) -> np.ndarray:
        """One margin per bit: mean log odds of the n-grams, scaled up with their number."""
        slots, counts = grams(text)
        n = counts.sum()
        return (self.weights[:, slots] @ counts) / n * min(24.0, np.sqrt(n)) + self.prior

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, and whether the second language is about as near."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        margin = self.margins(text)
        loss = self.trust * np.logaddexp(0, np.where(self.words, -margin, margin))
        total = loss.sum(1)
        p = np.exp(total.min() - total)
        p /= p.sum()
        first = int(np.argmin(total))
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        return self.languages[first], float(p[first]), bool(p[first] - second < GAP)


def _training(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most_checked: int = CHECK_ROWS) -> Model:
    """A model of all rows of ``docs`` that have a text and a language."""
    small_batches(docs.sparkSession)
    docs = _training(docs, text, lang)
    per = docs.groupBy(lang).count().orderBy(lang).limit(LANGUAGES + 1).collect()
    languages = [r[0] for r in per]
    if not languages:
        none = np.zeros(0)
        return Model([], none, none, none, none)
    words = codewords(len(languages))
    width = words.shape[1]
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        total = None
        def flush() -> None:
            nonlocal total
            total = np.zeros((width, 2, SLOTS)) if total is None else total
            for i, c in by.items():
                total[np.arange(width), words[i].astype(int)] += c
            by.clear()
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                slots, n = grams(t.as_py())
                by.setdefault(place[name], np.zeros(SLOTS))[slots] += n
            if len(by) > 64:
                flush()
        if by or total is not None:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["slot", "data"])

    rows = docs.select(octets(F.col(text)).alias("text"), F.col(lang).alias("lang"))
    sums = added(rows.mapInArrow(count, "slot int, data binary"), width)
    counts = np.stack([sums[b].reshape(2, SLOTS) for b in range(width)])
    odds = np.log((counts + SMOOTH) / (counts.sum(2, keepdims=True) + SMOOTH * SLOTS))
    documents = np.array([r[1] for r in per], float)
    ones, zeros = words.T.astype(float) @ documents, (~words).T.astype(float) @ documents
    model = Model(languages, words, odds[:, 1] - odds[:, 0], np.log((ones + 1) / (zeros + 1)), np.ones(width))
    draw = unit(F.xxhash64(F.col(text), F.lit("check"))) < most_checked / max(1.0, documents.sum())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(width + 1)
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                right[:width] += (model.margins(t.as_py()) > 0) == words[place[name]]
                right[width] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([right.tobytes()], pa.binary())], ["slot", "data"])

    some = docs.where(draw).select(octets(F.col(text)).alias("text"), F.col(lang).alias("lang"))
    right = added(some.mapInArrow(check, "slot int, data binary"), 1)[0]
    hit = (right[:width] + 1) / (right[width] + 2)
    model.trust = np.maximum(0.05, np.log(np.maximum(hit, 0.5) / (1 - np.minimum(hit, 0.999))) / np.log(999))
    return model


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and ``ambiguous`` of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                name, score, close = zip(*[model.predict(t.as_py()) for t in batch.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["key", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(key).alias("key"), octets(F.col(text)).alias("text"))
    return rows.mapInArrow(task, f"key {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)


@query("op5_langid")
def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    out = predicted(docs, model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
