"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all training rows. The weights are fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample (ROWS_PER_LANG rows of each language), one task's work of fixed size; a part of the sample that the
fit does not see sets the temperature of the probabilities. Every text is then scored whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, written

BITS = 16
SIZE = 1 << BITS
GRAMS = (1, 2, 3)
#: The sample that the weights are fitted on: so many rows of each language at most, those with the least hashes of their ids.
ROWS_PER_LANG = 1000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.5, 1.0, 0.05, 0.5
#: Term frequencies are shares of a text; this brings their products with inverse document frequencies near 1.
SCALE = 10.0
#: Texts are turned into n-grams together until they have so many characters.
CHUNK = 1 << 20
SPACE, BREAK = 32, 0
UND = "und"


@cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, each with a space at both ends and then a break; where each text starts; how many letters it has)."""
    parts, starts, letters, at = [], [], [], 0
    table = _letters()
    for t in texts:
        codes = table[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate(([SPACE], codes, [SPACE])).astype(np.uint32)
        blank = codes == SPACE
        codes = codes[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
        letters.append(int(len(blank) - blank.sum()))
        parts += [codes, np.array([BREAK], np.uint32)]
        starts.append(at)
        at += len(codes) + 1
    return np.concatenate(parts), np.array(starts), np.array(letters)


def _features(codes: np.ndarray, n: int) -> np.ndarray:
    """A feature number for each n-gram, by its first character; SIZE where it would cross a break."""
    wide = codes.astype(np.uint64)
    count = len(codes) - n + 1
    mixed = np.full(count, 0x9E3779B97F4A7C15 * n & (2**64 - 1), np.uint64)
    crosses = np.zeros(count, bool)
    for k in range(n):
        mixed = (mixed ^ wide[k:k + count]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        crosses |= codes[k:k + count] == BREAK
    out = (mixed >> np.uint64(64 - BITS)).astype(np.int32)
    out[crosses] = SIZE
    return np.concatenate((out, np.full(n - 1, SIZE, np.int32)))


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """How many texts have each feature, over all rows; last the number of rows. Each task sends SIZE sums at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SIZE + 1, np.int64)
        seen = np.zeros(SIZE + 1, bool)
        for batch in batches:
            for part in _chunks(batch.column(0).to_pylist()):
                codes, starts, _ = _encoded(part)
                grams = [_features(codes, n) for n in GRAMS]
                for a, b in zip(starts, [*starts[1:], len(codes)]):
                    for g in grams:
                        seen[g[a:b]] = True
                    seen[SIZE] = True
                    sums += seen
                    seen[:] = False
        at = sums.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["feature", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for r in docs.select(text).mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # SIZE + 1 rows at most
        out[r.feature] = r.n
    return out


def _rows_of(texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, TF-IDF values) of each text."""
    out = []
    for part in _chunks(texts):
        codes, starts, _ = _encoded(part)
        grams = [_features(codes, n) for n in GRAMS]
        for a, b in zip(starts, [*starts[1:], len(codes)]):
            f, c = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
            f, c = f[f < SIZE], c[f < SIZE]
            out.append((f, c / max(1, c.sum()) * idf[f]))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, temperature). Row SIZE of the weights is the bias. Every fifth row is kept from the fit, for the temperature."""
    z = np.zeros((SIZE + 1, n_classes))
    n = np.zeros((SIZE + 1, n_classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[::5] if len(rows) >= 10 else order
    taken = np.setdiff1d(order, held) if len(rows) >= 10 else order
    for epoch in range(EPOCHS):
        for i in np.random.default_rng([seed, epoch]).permutation(taken):
            f, x = rows[i]
            f, x = np.append(f, SIZE), np.append(x, 0.1)
            w = weights(f)
            p = _softmax(x @ w)
            p[classes[i]] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[f] += g - (np.sqrt(n[f] + g2) - np.sqrt(n[f])) / ALPHA * w
            n[f] += g2
    w = weights(slice(None))
    logits = np.array([np.append(x, 0.1) @ w[np.append(f, SIZE)] for f, x in (rows[i] for i in held)])
    truth = classes[held]
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(truth)), truth], 1e-12)).mean()
    low, high, golden = -1.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return w, float(np.exp((low + high) / 2))


class Model:
    """What scoring needs: languages, weights times idf, bias, temperature. SIZE x languages numbers, whatever the corpus."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.temperature = langs, temperature
        self.bias = weights[SIZE] * 0.1
        self.tables = [np.append(weights[:SIZE, c] * idf, 0.0).astype(np.float32) for c in range(len(langs))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for part in _chunks(texts):
            codes, starts, letters = _encoded(part)
            grams = [_features(codes, n) for n in GRAMS]
            total = sum(np.add.reduceat((g < SIZE).astype(np.int64), starts) for g in grams)
            logits = np.stack([sum(np.add.reduceat(t[g], starts, dtype=np.float64) for g in grams) for t in self.tables], axis=1) if self.langs else np.zeros((len(part), 0))
            for row, count, n in zip(logits, total, letters):
                if n == 0 or not self.langs:
                    names.append(UND)
                    scores.append(0.0)
                else:
                    p = _softmax((row / max(1, count) + self.bias) / self.temperature)
                    names.append(self.langs[int(p.argmax())])
                    scores.append(float(p.max()))
        return names, scores


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows of docs that have an id, a text and a language. With no such row it has no languages and predicts `und`.

    Of rows equal in id and language the least text is in the sample, so the model does not depend on how Spark partitions docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null and lang is not null")
    # A language's least hashes: those under a bound that some three times as many stay under, and of them the first.
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    many = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(3.0 * ROWS_PER_LANG) / F.count(F.lit(1))).alias("share"))
    near = rows.select("id", "lang").join(F.broadcast(many), "lang").where(place < F.col("share") * (1 << 40)).select("id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(place, "id")
    ids = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= ROWS_PER_LANG).select("id", "lang")
    ids = written(ids)  # ROWS_PER_LANG rows a language
    sample = written(rows.join(F.broadcast(ids), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")))
    langs = sorted(r.lang for r in ids.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros((SIZE + 1, 0)), np.zeros(SIZE), 1.0)
    counts = document_frequencies(rows, "text")
    idf = SCALE * (np.log((1 + counts[SIZE]) / (1 + counts[:SIZE])) + 1)

    def learn(_: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("id", "ascending"), ("lang", "ascending")])
        classes = np.array([langs.index(x) for x in part.column("lang").to_pylist()])
        weights, temperature = fit(_rows_of(part.column("text").to_pylist(), idf), classes, len(langs))
        np.savez_compressed(out := io.BytesIO(), weights=weights.astype(np.float32), temperature=temperature)
        return pa.table({"model": pa.array([out.getvalue()], pa.binary())})

    made = np.load(io.BytesIO(bytes(sample.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "model binary").collect()[0].model)))
    return Model(langs, made["weights"], idf, float(made["temperature"]))


def predicted(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its calibrated probability; `und` and 0 for a text that is null or has no letter.

    Only the text decides. Texts of any length are scored whole. Extra columns of docs that bear the result names give way."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    schema = docs.schema
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sure = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(score, StructType([*(StructField(f.name, f.dataType, True) for f in schema), StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def remainder(doc_id):
    """crc32 of the id as text, modulo 5: null for a null id, which is then neither held out nor learned from."""
    return F.crc32(doc_id.cast("string")) % 5


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document. An empty table gives no rows; repeated rows get equal results; of equal probabilities the first language by name is predicted; columns other than doc_id, text and lang do not matter, whatever their names."""
    model = train(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id")) != 0))
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a predicted language with probability `least` or more."""
    model = train(docs.where(remainder(F.col("doc_id")) != 0))
    lang, score = fresh(docs, "_lang", "_score")
    return predicted(docs, model, names=(lang, score)).where((F.col(lang) != UND) & (F.col(score) >= least)).drop(lang, score)
