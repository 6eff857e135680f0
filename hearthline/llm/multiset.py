"""Order-independent document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (what stands between line ends, empty ones too) is hashed to a wide vector: EXACT numbers
mod 2^64 from its bytes, and LIKE numbers mod 2^32 to which each word, with up to two words after it in
the paragraph, adds or takes one. A document's fingerprint is the sum of its paragraphs' vectors, so it
doesn't depend on their order, and paragraphs are put in or taken out by adding or subtracting.

Equal texts have equal fingerprints. How alike two texts are is the cosine of the second parts, read as
signed numbers, between 0 and 1; equal first parts are 1. A lane would have to count 2^31 words to change its sign.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm import hashing
from hearthline.llm.tables import mapped, ship, steps, table

U64 = np.uint64
EXACT, LIKE = 8, 256
#: Characters of text that are compared at once.
STEP = 1 << 19
_NEXT = hashing.stream(31, 2) | U64(1)


def fingerprints(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's fingerprint: a row of EXACT uint64 and a row of LIKE uint32."""
    exact = np.zeros((len(raw), EXACT), U64)
    with np.errstate(over="ignore"):
        for i, one in enumerate(raw):
            digests = b"".join([hashlib.blake2b(p).digest() for p in one.split(b"\n")])
            exact[i] = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=U64)
    if not raw:
        return exact, np.zeros((0, LIKE), np.uint32)
    data, starts = hashing.joined(raw)
    word, first, index = hashing.words(data, starts, lower=False)
    text_of = np.repeat(np.arange(len(raw)), np.diff(index))
    paragraph = np.searchsorted(np.flatnonzero(data == 10), first) + text_of
    with np.errstate(over="ignore"):
        near = word.copy()
        for k in (1, 2):
            same = paragraph[k:] == paragraph[:-k] if len(word) > k else np.zeros(0, bool)
            near[: len(same)][same] += word[k:][same] * _NEXT[k - 1]
    near = hashing.mix(near)
    lane = text_of * LIKE + (near >> U64(56)).astype(np.int64)
    sign = (near & U64(1)).astype(np.float64) * 2 - 1
    like = np.bincount(lane, sign, minlength=len(raw) * LIKE).reshape(-1, LIKE)
    return exact, like.astype(np.int64).astype(np.uint32)


def written(exact: np.ndarray, like: np.ndarray) -> list[str]:
    """Each fingerprint as one base64 string, little-endian."""
    return [base64.b64encode(a.astype("<u8").tobytes() + b.astype("<u4").tobytes()).decode() for a, b in zip(exact, like, strict=True)]


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(text)
    return np.frombuffer(raw[: EXACT * 8], "<u8"), np.frombuffer(raw[EXACT * 8 :], "<u4")


def combine(one: str, other: str, sign: int = 1) -> str:
    """The fingerprint of both multisets together (sign 1) or of the first without the second (-1).

    Joining two texts with a line end puts their paragraphs together.
    """
    (a, b), (c, d) = read(one), read(other)
    with np.errstate(over="ignore"):
        return written((a + U64(sign % 2**64) * c)[None], (b + np.uint32(sign % 2**32) * d)[None])[0]


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per row, 0 to 1."""
    a, b = one[1].astype(np.int32).astype(float), other[1].astype(np.int32).astype(float)
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    return np.where((one[0] == other[0]).all(1), 1.0, np.clip(cosine, 0, 1))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the start of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list, texts: list[str], following: list[str], next_prints=None) -> pa.RecordBatch:
    """Rows of SCHEMA. next_prints: the fingerprints of `following`, if known."""
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    own, new = fingerprints([x.encode() for x in texts]), fingerprints(changed)
    if next_prints is None:  # following is texts moved up by one, and one more
        last = fingerprints([x.encode() for x in following[-1:]])
        next_prints = tuple(np.concatenate((a[1:], b)) for a, b in zip(own, last, strict=True))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
        pa.array(written(*own), pa.string()),
        pa.array(written(*new), pa.string()),
        pa.array(likeness(own, new), pa.float64()),
        pa.array(likeness(own, next_prints), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def _within(batches):
    """Compare each row with the next one of its bucket; a bucket's last row gives nothing here."""
    ids, texts, sizes, bucket = [], [], 0, None

    def flush():
        return compared(ids[:-1], texts[:-1], texts[1:])

    for batch in (step for whole in batches for step in steps(whole)):
        columns = (batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))
        for at, i, text in zip(*columns, strict=True):
            if at != bucket or sizes > STEP:
                if len(ids) > 1:
                    yield flush()
                ids, texts, sizes, bucket = ([], [], 0, at) if at != bucket else (ids[-1:], texts[-1:], len(texts[-1]), at)
            ids.append(i)
            texts.append(text)
            sizes += len(text)
    if len(ids) > 1:
        yield flush()


def buckets(docs: DataFrame, count: int) -> DataFrame:
    """Adds `bucket`: `count` ranges of doc_id with about as many rows each, in ascending order; 0 for missing ids.

    The borders are `count` approximate quantiles, fetched once, so every task deals alike.
    """
    shares = [i / count for i in range(1, count)] or [0.5]
    from pyspark.ml.feature import Bucketizer  # on the driver only: workers do without its memory

    borders = docs.select(F.percentile_approx("doc_id", shares, 100 * count)).first()[0] or [0]
    splits = [float("-inf"), *sorted({float(x) for x in borders}), float("inf")]
    place = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket", handleInvalid="keep")
    numbered = place.transform(docs.withColumn("_place", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_bucket").cast("int") + 1)
    return numbered.withColumn("bucket", bucket).drop("_place", "_bucket")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of SCHEMA for each row of docs (doc_id, text), next meaning ascending doc_id, around the end.

    Rows without an id come first, and rows of one id are ordered by a hash of their text. A missing text is
    empty. Texts are dealt once, by ranges of doc_id; where a range ends, its last row meets the first of the
    next range in a join of as many rows as there are ranges.
    """
    spark = docs.sparkSession
    ship(spark)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = buckets(rows, count).withColumn("h", F.xxhash64("text"))
    inner = rows.repartitionByRange(count, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "h").mapInArrow(_within, SCHEMA)
    row = F.struct("doc_id", "h", "text")
    ends = rows.groupBy("bucket").agg(F.min(row).alias("head"), F.max(row).alias("tail"))
    every = Window.orderBy("bucket")  # one number per range
    follows = rows.select("bucket").distinct().select("bucket", F.lead("bucket").over(every).alias("after"), F.min("bucket").over(Window.partitionBy()).alias("least"))
    follows = follows.select("bucket", F.coalesce("after", "least").alias("after"))
    heads = ends.select(F.col("bucket").alias("after"), F.col("head.text").alias("next_text"))
    tails = ends.select("bucket", "tail.doc_id", "tail.text").join(follows, "bucket").join(heads, "after").select("doc_id", "text", "next_text")

    def outer(batch: pa.RecordBatch) -> pa.RecordBatch:
        following = batch.column("next_text").to_pylist()
        prints = fingerprints([x.encode() for x in following])
        return compared(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), following, prints)

    return inner.unionByName(mapped(tails, outer, SCHEMA))


def op4_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half from the next document.

    Empty texts are one empty paragraph. A single document is its own next one; no documents, no rows.
    """
    return with_next(table(spark, sf_dir, "documents", "doc_id", "text"))
