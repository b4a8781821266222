"""Document quality: logistic regression on hashed word n-grams, trained with FTRL.

A text is its words (runs of characters other than white space).  Its n-grams are single words and
pairs, the same of the words' shapes (case, digits, marks at either end, length), whether a word
repeats the one before, and whether a triple of words was there before.  Each is hashed to one
of SPACE weights; a kind's value is the share that an n-gram has of its text's n-grams of that kind, so
that a score is a sparse dot product and does not depend on the text's length.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import labelled
from cleanloom.llm.common import aside, map_batches

SPACE = 1 << 18
#: Labelled rows that are learned from, at most, and passes over few rows.
TRAIN_ROWS = 12_000
STEPS = 48_000
MOST_PASSES = 30
THRESHOLD = 0.3
MADE = ("quality_score", "quality_predicted")
#: Words that are worked on at once.
BLOCK = 1 << 18
#: Follow-the-regularised-leader: learning rate, its smoothing, and the weights of |w| and w**2 / 2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.5


def byte_classes() -> np.ndarray:
    """A class for each byte: 0 other, 1 lower case or part of a wide character, 2 upper case, 3 digit, 4 on: each mark."""
    out = np.zeros(256, np.uint64)
    for b in range(256):
        c = chr(b)
        out[b] = 1 if b >= 128 or c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 + b if 33 <= b < 127 else 0
    return out


CLASS = byte_classes()


def hashed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(40)) & np.uint64(SPACE - 1)).astype(np.int64)


def ngrams(words: list[bytes], text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hashed n-gram, value); `text` has the number of the text of each word, ascending."""
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter(map(digest, words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = CLASS[np.frombuffer(b"".join(words), np.uint8)]
    end = np.cumsum(size)
    first, last, before = data[end - size], data[end - 1], data[np.maximum(end - 2, end - size)]
    second = data[np.minimum(end - size + 1, end - 1)]
    shape = (((first * np.uint64(131) + second) * np.uint64(131) + before) * np.uint64(131) + last) * np.uint64(8) + np.minimum(size // 4, 7).astype(np.uint64)
    pair = text[1:] == text[:-1]
    same = (word[1:] == word[:-1]).astype(np.uint64)
    triple = mix3(word) if len(word) > 2 else np.empty(0, np.uint64)
    in_one = text[2:] == text[:-2]
    triple_text = text[2:][in_one]
    named = triple[in_one] ^ (triple_text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, code = np.unique(named, return_index=True)
    seen = np.ones(len(named), np.uint64)
    seen[code] = 0
    kinds = [
        (text, word),
        (text[1:][pair], (word[:-1] * np.uint64(0x9FB21C651E98DF25) ^ word[1:])[pair]),
        (text, shape),
        (text[1:][pair], (shape[:-1] * np.uint64(0x9FB21C651E98DF25) ^ shape[1:])[pair]),
        (text[1:][pair], same[pair]),
        (triple_text, seen),
    ]
    at, grams, values = [], [], []
    n = int(text[-1]) + 1 if len(text) else 0
    for kind, (of, x) in enumerate(kinds, 1):
        at.append(of)
        grams.append(hashed(x, kind))
        values.append(1 / np.maximum(np.bincount(of, minlength=n), 1)[of])
    return np.concatenate(at), np.concatenate(grams), np.concatenate(values)


def mix3(word: np.ndarray) -> np.ndarray:
    x = (word[:-2] * np.uint64(0x9FB21C651E98DF25) ^ word[1:-1]) * np.uint64(0x9FB21C651E98DF25) ^ word[2:]
    return x ^ (x >> np.uint64(29))


def blocks(texts: list[str | None]) -> Iterator[tuple[range, list[bytes], np.ndarray]]:
    """Texts in groups of about BLOCK words: their numbers, all words, and each word's place in the group."""
    begin, words, sizes = 0, [], []
    for k, one in enumerate(texts):
        own = (one or "").encode().split()
        words += own
        sizes.append(len(own))
        if len(words) >= BLOCK:
            yield range(begin, k + 1), words, np.repeat(np.arange(len(sizes)), sizes)
            begin, words, sizes = k + 1, [], []
    if sizes:
        yield range(begin, len(texts)), words, np.repeat(np.arange(len(sizes)), sizes)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """SPACE weights and the constant, by passes over (n-grams, values, label 0/1) in the given order."""
    z, n, w = (np.zeros(SPACE + 1) for _ in range(3))
    for _ in range(min(MOST_PASSES, max(1, round(STEPS / max(1, len(rows)))))):
        for grams, values, label in rows:
            zi, ni = z[grams], n[grams]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            w[grams] = wi
            p = 1 / (1 + np.exp(-np.clip(wi @ values, -35, 35)))
            g = (p - label) * values
            z[grams] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[grams] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, from at most `rows` labelled rows that are not held out.

    Their n-grams are made where the rows are; FTRL is a sequence of steps, so one task takes them, in
    the order of their hashed keys, and returns the weights alone.  Without labelled rows all weights are zero.
    """

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams: list = []
            values: list = []
            for numbers, words, text in blocks(b.column(1).to_pylist()):
                of, gram, value = ngrams(words, text) if words else (np.empty(0, np.int64),) * 3
                key, code = np.unique(of * SPACE + gram, return_inverse=True)
                total = np.bincount(code, value, len(key)).astype(np.float32)
                ends = np.searchsorted(key, np.arange(1, len(numbers)) * SPACE)
                grams += np.split((key % SPACE).astype(np.int32), ends)
                values += np.split(total, ends)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), b.column(2)], names=["place", "grams", "weights", "label"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for g, v, y in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                g, v = g.values.to_numpy(), v.values.to_numpy()
                rows.append((np.append(g, SPACE), np.append(v, np.float32(1)), y))
        out = io.BytesIO()
        np.savez_compressed(out, w=ftrl(rows))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["w"])

    some = labelled.sample(docs, labels, label, rows)
    made = map_batches(some, featured, "place long, grams array<int>, weights array<float>, label int")
    one = map_batches(made.repartition(1).sortWithinPartitions("place"), fitted, "w binary").first()
    return np.load(io.BytesIO(bytes(one[0])))["w"] if one else np.zeros(SPACE + 1)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows and columns, with quality_score (0 to 1) and quality_predicted (1 from the threshold on).

    A null or empty text has no n-grams and gets the constant's score.  Repeated rows are scored each.
    Columns of these two names are replaced; `keep` leaves them alone.
    """
    rows, back = aside(docs.drop(*MADE), ["__text"])
    model = docs.sparkSession.sparkContext.broadcast(weights)  # SPACE + 1 numbers, whatever the input
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            out = []
            for numbers, words, text in blocks(b.column(len(names)).to_pylist()):
                of, gram, value = ngrams(words, text) if words else (np.empty(0, np.int64),) * 3
                out.append(np.bincount(of, w[gram] * value, len(numbers)) + w[SPACE])
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.empty(0), -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, *MADE])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", quality_score double, quality_predicted int"
    return back(map_batches(rows.select("*", F.col(text).cast("string").alias("__text")), run, schema))


def evaluate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted."""
    weights = train(docs, labels)
    rows = score(docs.select("doc_id", "text"), weights)
    return rows.select("doc_id", labelled.held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score is under the threshold; all columns stay, whatever they are called."""
    rows, back = aside(docs, MADE)
    return back(score(rows, train(docs, labels), threshold=threshold).where("quality_predicted = 1").drop(*MADE))
