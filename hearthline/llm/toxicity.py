"""Toxicity scores from character n-grams: a linear classifier on naive-Bayes-scaled features.

A text's features are the distinct 3- to 5-grams of its characters (code points; A-Z lowered, runs of
white space as one space), hashed to `bits` bits. Over the labelled texts each feature has a log-count ratio
r = log((1 + p) / (1 + P)) - log((1 + q) / (1 + Q)), where p of P toxic and q of Q other texts hold it:
features are held or not, so each class is scaled by its number of texts. A logistic regression is
fitted on the features times r; a text's score is its probability.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import hashing
from hearthline.llm.tables import mapped, table, texts

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled texts that the fit sees, half of them toxic where there are as many;
    of each label those with the smallest md5 of their id are taken. The fit and the scores use whole texts.

    Features in fewer than `least_texts` of these texts, or whose ratio is within `least_ratio` of zero (about as
    frequent in both classes), get no weight. After `steps` Newton steps a fit that hasn't come to rest warns.
    """

    sample: int = 4000
    bits: int = 18
    least_texts: int = 5
    least_ratio: float = 0.7
    penalty: float = 1.0
    steps: int = 40
    threshold: float = 0.3


_GRAMS = (3, 4, 5)
_WEIGHT = hashing.stream(21, 8) | U64(1)
_SEED = U64(22)


def _codes(points: np.ndarray) -> np.ndarray:
    """A fixed 64-bit number for each code point."""
    with np.errstate(over="ignore"):
        return hashing.mix((points.astype(U64) + U64(1) + _SEED * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_ASCII = _codes(np.arange(128))


def _characters(clean: bytes) -> np.ndarray:
    """The characters' numbers, A-Z lowered; bytes that are no UTF-8 count as one character of their own kind."""
    if clean.isascii():
        return _ASCII[hashing.LOWER[np.frombuffer(clean, np.uint8)]]
    points = np.frombuffer(clean.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return _codes(np.where((points >= 65) & (points <= 90), points + np.uint32(32), points))


def features(raw: list[bytes], bits: int) -> list[np.ndarray]:
    """Distinct feature numbers of each text; none for a text without characters but white space."""
    stamp = np.zeros(1 << bits, np.int32)
    out = []
    for one in raw:
        clean = b" " + b" ".join(one.split()) + b" "
        if len(clean) <= 2:
            out.append(np.zeros(0, np.int32))
            continue
        code = _characters(clean)
        found = []
        with np.errstate(over="ignore"):
            rolled = code[: len(code) - 1] * _WEIGHT[0] + code[1:] * _WEIGHT[1]
            for n in _GRAMS:
                if len(code) < n:
                    break
                rolled = rolled[: len(code) - n + 1] + code[n - 1 :] * _WEIGHT[n - 1]
                found.append((rolled * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits))
        every = np.concatenate(found).astype(np.int32)
        order = np.arange(len(every), dtype=np.int32)
        stamp[every] = order
        out.append(every[stamp[every] == order])
    return out


def fit(raw: list[bytes], labels: list[int], settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """fit_sets() on the features of these texts."""
    return fit_sets(features(raw, settings.bits), labels, settings)


def fit_sets(sets: Iterable[np.ndarray], labels: list[int], settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights per feature (already times the log-count ratio) and the intercept, from each text's features (gone through twice).

    Newton steps with conjugate gradients on the penalised logistic loss; classes weigh the same in total.
    Without texts of both labels the weights are zero and the score is the share of toxic ones (0 without any).
    """
    size = 1 << settings.bits
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(size, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    held, toxic = np.zeros(size), np.zeros(size)
    for own, label in zip(sets, labels, strict=True):
        held[own] += 1
        if label:
            toxic[own] += 1
    ratio = np.log((1 + toxic) / (y.sum() + 1)) - np.log((1 + held - toxic) / ((1 - y).sum() + 1))
    names = np.flatnonzero((held >= settings.least_texts) & (np.abs(ratio) > settings.least_ratio))
    place = np.full(size, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    sets = [found[found >= 0] for found in (place[own] for own in sets)]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    col = np.concatenate(sets)
    value = ratio[names][col]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(len(names)), 0.0

    def times(v):
        return np.bincount(row, value * v[col], len(y))

    def back(u):
        return np.bincount(col, value * u[row], len(names))

    for _ in range(settings.steps):
        z = times(w) + b
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = weight * (prob - y)
        gw, gb = back(g) + settings.penalty * w, g.sum()
        if np.abs(gw).max(initial=0) < 1e-3 and abs(gb) < 1e-3:
            break
        h = weight * np.maximum(prob * (1 - prob), 1e-6)
        dw, db = np.zeros_like(w), 0.0
        rw, rb = -gw, -gb
        pw, pb = rw.copy(), rb
        rr = rw @ rw + rb * rb
        for _ in range(15):
            u = h * (times(pw) + pb)
            hw, hb = back(u) + settings.penalty * pw, u.sum()
            step = rr / (pw @ hw + pb * hb)
            dw, db, rw, rb = dw + step * pw, db + step * pb, rw - step * hw, rb - step * hb
            new = rw @ rw + rb * rb
            if new < 1e-6:
                break
            pw, pb, rr = rw + new / rr * pw, rb + new / rr * pb, new
        w, b = w + dw, b + db
    else:
        warnings.warn(f"the toxicity model hasn't come to rest in {settings.steps} steps", RuntimeWarning, stacklevel=2)
    full = np.zeros(size, np.float32)
    full[names] = w * ratio[names]
    return full, float(b)


def probabilities(raw: list[bytes], weights: np.ndarray, intercept: float, bits: int) -> np.ndarray:
    z = np.array([weights[s].sum(dtype=np.float64) for s in features(raw, bits)]) + intercept
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """A bounded sample of labelled texts: doc_id, text, y, at most `limit` // 2 of each label.

    Rows whose crc32(doc_id) mod `modulus` is `held_out` are left out; so are missing ids, texts and
    labels. Which rows are taken depends on their id only. Of several labels of an id the larger counts,
    of several texts the first in order of their bytes.
    """
    learn = F.crc32(F.col("doc_id").cast("string")) % modulus != held_out
    named = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.md5(F.col("doc_id").cast("string"))
    parts = [named.where(F.col("y") == y).orderBy(order, "doc_id").limit(limit // 2) for y in (0, 1)]
    wanted = F.broadcast(parts[0].unionByName(parts[1]))  # at most `limit` rows of an id and a label
    texts_ = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(wanted, "doc_id")
    return texts_.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def _written(found: np.ndarray, bits: int) -> bytes:
    """Feature numbers, or a bit for each possible one where that is shorter: 2^bits / 8 bytes at most."""
    if 4 * len(found) < (1 << bits) // 8:
        return np.sort(found).tobytes()
    held = np.zeros(1 << bits, bool)
    held[found] = True
    return np.packbits(held).tobytes()


def _read(written: bytes, bits: int) -> np.ndarray:
    if len(written) < (1 << bits) // 8:
        return np.frombuffer(written, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(written, np.uint8))).astype(np.int32)


class _Sets:
    """Texts' features, read from their written form one text at a time, whenever they are gone through."""

    def __init__(self, written: pa.ChunkedArray, order: pa.Array, bits: int) -> None:
        self.written, self.order, self.bits = written, order.to_pylist(), bits

    def __iter__(self) -> Iterator[np.ndarray]:
        return (_read(self.written[i].as_py(), self.bits) for i in self.order)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()):
    """Weights and intercept from the labelled rows whose crc32(doc_id) mod 4 is not 2.

    Tasks turn whole texts into features; only the distinct feature numbers of the sampled rows are collected.
    """
    rows = labelled(docs, labels, "toxic", 4, 2, settings.sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [_written(found, settings.bits) for found in features([x.encode() for x in texts(batch)], settings.bits)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(sets, pa.binary())], ["doc_id", "y", "features"])

    rows = rows.select("doc_id", "text", F.col("y").cast("int").alias("y"))
    found = mapped(rows, work, "doc_id long, y int, features binary").toArrow()  # `sample` rows at most
    order = pc.sort_indices(found, sort_keys=[("doc_id", "ascending")])
    return fit_sets(_Sets(found.column("features"), order, settings.bits), found.column("y").take(order).to_pylist(), settings)


def scored(docs: DataFrame, weights: np.ndarray, intercept: float, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score per row of docs, over whole texts; a missing text scores as an empty one."""
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept))  # 2^bits numbers, whatever the data

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.encode() for x in texts(batch)]
        score = probabilities(raw, *model.value, settings.bits)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted.

    Empty and missing texts get the score of a text without features; repeated rows get a row each; a
    missing doc_id is scored, with held_out NULL. Without labels every score is about 0; no documents: no rows.
    A text of any length is scored whole.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(spark, docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), settings)
    return scored(docs, *model, settings).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; the model learns from the labels in sf_dir."""
    weights, intercept = train(spark, docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), settings)
    model = spark.sparkContext.broadcast((weights, intercept))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = probabilities([x.encode() for x in texts(batch)], *model.value, settings.bits)
        return batch.filter(pa.array(score < settings.threshold))

    return mapped(docs, work, docs.schema)
