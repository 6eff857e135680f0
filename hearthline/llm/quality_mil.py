"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of `words` words. Each passage is described by shares of character classes,
of pairs of neighbouring classes, of hashed words, and by how often its words repeat; a learned layer
encodes that as a vector h. Gated attention gives passage k the weight softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)));
the weighted sum of the vectors goes through a logistic output. Only labels of whole texts are used to learn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import hashing
from hearthline.llm.tables import keep, mapped, table, texts
from hearthline.llm.toxicity import labelled

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled texts that the fit sees, half of each label where there are as many (those
    with the smallest md5 of their id). `passages` bounds the passages that the driver holds for the fit, half of
    them for each label: in that order, a text of the sample is left out if it doesn't fit into what is left of
    them. The fit and the scores use whole texts."""

    sample: int = 3000
    passages: int = 150_000
    words: int = 64
    encoded: int = 24
    attention: int = 12
    rounds: int = 250
    rate: float = 0.02
    decay: float = 1e-4
    threshold: float = 0.3


#: Character classes by byte: lower, upper, digit, blank, line end, sentence marks, symbols, other ASCII, beyond ASCII.
_CLASS = np.full(256, 7, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
for _marks, _number in ((b" \t\x0b\x0c\r", 3), (b"\n", 4), (b".,;:'\"-?()", 5), (b"#*$%&|<>", 6)):
    _CLASS[list(_marks)] = _number
_CLASSES, _BUCKETS = 9, 64
WIDTH = _CLASSES + _CLASSES**2 + _BUCKETS + 6


def passages(raw: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of WIDTH numbers per passage, and where each text's rows start (and the last ends).

    A text without words is one passage of zeros. What comes before a text's first word belongs to its first
    passage, what follows a word to the word's; a row depends on its own text alone.
    """
    data, starts = hashing.joined(raw)
    hashed, first, index = hashing.words(data, starts)
    counts = np.diff(index)
    bags = np.maximum(1, -(-counts // words))
    rows = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(bags, out=rows[1:])
    text_of = np.repeat(np.arange(len(raw)), counts)
    row = rows[text_of] + (np.arange(len(hashed)) - index[text_of]) // words  # of each word
    n = int(rows[-1])
    out = np.zeros((n, WIDTH), np.float32)
    if not len(hashed):
        return out, rows
    begins = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
    place = np.zeros(n + 1, np.int64)  # of each row's first byte
    place[row[begins]] = first[begins]
    place[rows] = starts
    byte_row = np.repeat(np.arange(n), np.diff(place))
    kind = _CLASS[data]
    size = np.maximum(1, np.diff(place))[:, None]
    out[:, :_CLASSES] = np.bincount(byte_row * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, -1) / size
    pair = (byte_row[1:] * _CLASSES + kind[:-1]) * _CLASSES + kind[1:]
    pair = np.delete(pair, starts[1:-1] - 1)  # a text's last byte and the next one's first are no pair
    out[:, _CLASSES : _CLASSES + _CLASSES**2] = np.bincount(pair, minlength=n * _CLASSES**2).reshape(n, -1) / size
    held = np.maximum(1, np.bincount(row, minlength=n)).astype(float)
    bucket = (hashed >> U64(58)).astype(np.int64)
    at = _CLASSES + _CLASSES**2
    out[:, at : at + _BUCKETS] = np.sqrt(np.bincount(row * _BUCKETS + bucket, minlength=n * _BUCKETS).reshape(n, -1) / held[:, None])

    def share(flag):
        return np.bincount(row, flag, minlength=n) / held

    at += _BUCKETS
    for k, back in enumerate((1, 2)):
        flag = np.zeros(len(hashed))
        flag[back:] = (hashed[back:] == hashed[:-back]) & (row[back:] == row[:-back])
        out[:, at + k] = share(flag)
    length = np.minimum(np.append(first[1:], len(data)), starts[text_of + 1]) - first
    out[:, at + 2] = share(np.minimum(length, 40) / 40)
    out[:, at + 3] = np.bincount(row, minlength=n) / words
    order = np.lexsort((hashed, row))
    fresh = np.ones(len(hashed))
    fresh[order[1:]] = (hashed[order[1:]] != hashed[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    out[:, at + 4] = share(fresh)
    out[:, at + 5] = share(_seen_before(hashed, index))
    out[rows[:-1][counts == 0]] = 0
    return out, rows


def _seen_before(hashed: np.ndarray, index: np.ndarray) -> np.ndarray:
    """1 for words that begin a triple of words found earlier in the same text."""
    seen = np.zeros(len(hashed))
    if len(hashed) < 3:
        return seen
    with np.errstate(over="ignore"):
        triple = hashing.mix(hashed[:-2] + hashed[1:-1] * U64(3) + hashed[2:] * U64(5))
    for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True):
        if b - a > 3:
            mine = triple[a : b - 2]
            once = np.zeros(len(mine), bool)
            once[np.unique(mine, return_index=True)[1]] = True
            seen[a : b - 2] = ~once
    return seen


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(x: np.ndarray, rows: np.ndarray, model: dict[str, np.ndarray]):
    """Score per text, and what the gradients need."""
    x = (x - model["mean"]) / model["spread"]
    h = np.tanh(x @ model["E"] + model["e"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    a = (t * g) @ model["w"]
    begins, counts = rows[:-1], np.diff(rows)
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, begins), counts))
    a /= np.repeat(np.add.reduceat(a, begins), counts)
    z = np.add.reduceat(a[:, None] * h, begins)
    return _sigmoid(z @ model["c"] + model["b"]), (x, h, t, g, a, z)


def fit(x: np.ndarray, rows: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> dict[str, np.ndarray]:
    """Adam over all bags at once; both labels weigh the same. Bags of one label only: a constant score."""
    rng = np.random.default_rng(7)
    d, m, k = x.shape[1], settings.encoded, settings.attention
    model = {
        "mean": x.mean(0) if len(x) else np.zeros(d),
        "spread": (x.std(0) if len(x) else np.zeros(d)) + 0.02,
        "E": rng.normal(0, d**-0.5, (d, m)), "e": np.zeros(m), "V": rng.normal(0, m**-0.5, (m, k)),
        "U": rng.normal(0, m**-0.5, (m, k)), "w": rng.normal(0, k**-0.5, k), "c": np.zeros(m), "b": np.zeros(1),
    }
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return model | {"b": np.array([np.log((share + 1e-6) / (1 - share + 1e-6))])}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    names = ["E", "e", "V", "U", "w", "c", "b"]
    first = {n: np.zeros_like(model[n]) for n in names}
    second = {n: np.zeros_like(model[n]) for n in names}
    begins, counts = rows[:-1], np.diff(rows)
    for step in range(1, settings.rounds + 1):
        p, (xs, h, t, g, a, z) = forward(x, rows, model)
        out = weight * (p - y)
        dz = np.repeat(out, counts)[:, None] * model["c"]
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, begins), counts))
        dtg = da[:, None] * model["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
        grads = {"E": xs.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ out, "b": out.sum(keepdims=True)}
        for n in names:
            grad = grads[n] + settings.decay * model[n]
            first[n] = 0.9 * first[n] + 0.1 * grad
            second[n] = 0.999 * second[n] + 0.001 * grad * grad
            model[n] = model[n] - settings.rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def scores(raw: list[bytes], model: dict[str, np.ndarray], words: int) -> np.ndarray:
    x, rows = passages(raw, words)
    return forward(x, rows, model)[0]


def fitting(sizes: list[tuple[int, int, int]], room: int) -> list[int]:
    """Of (id, label, passages) in their order: the ids that fit into the room of their label."""
    left, ids = {0: room, 1: room}, []
    for doc_id, y, n in sizes:
        if n <= left[y]:
            left[y] -= n
            ids.append(doc_id)
    return ids


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict[str, np.ndarray]:
    """A model from the labelled rows whose crc32(doc_id) mod 5 is not 0.

    Tasks turn whole texts into passages' numbers and store them; the driver reads how many each text of the sample
    has, and then those of the texts that fit into the bound.
    """
    rows = labelled(docs, labels, "quality", 5, 0, settings.sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, at = passages([t.encode() for t in texts(batch)], settings.words)
        bags = [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(bags, pa.binary())], ["doc_id", "y", "bag"])

    rows = rows.select("doc_id", "text", F.col("y").cast("int").alias("y"))
    stored = keep(mapped(rows, work, "doc_id long, y int, bag binary"))
    size = (F.octet_length("bag") / (4 * WIDTH)).cast("long").alias("n")
    sizes = stored.select("doc_id", "y", size).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").collect()  # `sample` rows at most
    chosen = stored.where(F.col("doc_id").isin(fitting(sizes, settings.passages // 2)))
    found = chosen.toArrow().sort_by("doc_id")  # `passages` passages at most
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in found.column("bag").to_pylist()]
    x = np.concatenate([np.zeros((0, WIDTH), np.float32), *bags])
    starts = np.cumsum([0, *map(len, bags)])
    return fit(x, starts, np.array(found.column("y").to_pylist(), float), settings)


def scored(docs: DataFrame, model: dict[str, np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """doc_id, score per row of docs, over every passage of the text; a missing text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = scores([x.encode() for x in texts(batch)], shared.value, settings.words)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Every document's quality: doc_id, held_out, score, predicted.

    Empty and missing texts are one empty passage; repeated rows get a row each; a missing doc_id is
    scored, with held_out NULL. Without labels every score is about 1; no documents: no rows. A text of any
    length is scored whole.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), settings)
    return scored(docs, model, settings).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
