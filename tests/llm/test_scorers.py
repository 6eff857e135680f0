"""The two trained scorers: held-out accuracy, whole texts, gradients."""

import zlib

import corpora
import numpy as np
import pyarrow.parquet as pq
import pytest

from hearthline.llm import hashing, quality_mil, toxicity

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    ("query", "label", "modulus", "held", "least"),
    [(quality_mil.op2_quality, "quality", 5, 0, 0.97), (toxicity.op10_toxicity, "toxic", 4, 2, 0.93)],
)
def test_held_out_accuracy(spark, query, label, modulus, held, least):
    rows = query(spark, LARGE).toPandas()
    assert len(rows) == 10_000 and rows.doc_id.is_unique
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % modulus == held for i in rows.doc_id]).all()
    known = rows.merge(pq.read_table(f"{LARGE}/labels.parquet").to_pandas(), on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known[label]).mean() > least
    assert known[known[label] == 1].score.median() > 0.9 > 0.1 > known[known[label] == 0].score.median()


def test_a_score_depends_on_the_text_alone(spark, tmp_path):
    """Same texts under other ids, and labels of held-out rows turned round."""
    table = pq.read_table(f"{corpora.SMALL}/documents.parquet").to_pandas()
    labels = pq.read_table(f"{corpora.SMALL}/labels.parquet").to_pandas()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels.itertuples(index=False)]
    rows = [(i, x, "elsewhere") for i, x in zip(table.doc_id, table.text, strict=True)]
    extra = [(10**6 + i, x, None) for i, x, _ in rows]
    one = toxicity.op10_toxicity(spark, corpora.SMALL).toPandas().set_index("doc_id").score
    other = toxicity.op10_toxicity(spark, corpora.write(tmp_path, rows + extra, labels=turned)).toPandas().set_index("doc_id").score
    assert np.allclose(one, other[one.index]) and np.allclose(one, other[one.index + 10**6])


def test_features_see_the_end_of_a_long_text():
    plain, ended = b"word " * 50_000, b"word " * 50_000 + b"idiot"
    one, other = toxicity.features([plain, ended], 18)
    assert set(one) < set(other) and len(set(other)) == len(other)


def test_log_count_ratios_find_the_word():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) for _ in range(200)]
    labels = [i % 4 == 0 for i in range(200)]
    raw = [(t + " awful" * y).encode() for t, y in zip(texts, labels, strict=True)]
    weights, intercept = toxicity.fit(raw, [int(y) for y in labels])
    p = toxicity.probabilities([b"alpha beta awful", b"alpha beta gamma"], weights, intercept, 18)
    assert p[0] > 0.8 and p[1] < 0.3


def test_passages_cover_the_text():
    raw = [b"", b"one two three", b"x " * 1000, "é ü".encode()]
    x, rows = quality_mil.passages(raw, 64)
    assert np.diff(rows).tolist() == [1, 1, 16, 1] and len(x) == 19
    assert (x[0] == 0).all() and np.isfinite(x).all()


def test_gradients_of_the_attention_model():
    """One plain step downhill along each parameter's numeric gradient agrees with where Adam heads."""
    rng = np.random.default_rng(1)
    x, rows, y = rng.normal(size=(40, 6)), np.arange(0, 41, 4), np.arange(10) % 2
    settings = quality_mil.Settings(encoded=4, attention=3, rounds=1, decay=0.0)
    start = quality_mil.fit(x, rows, y.astype(float), quality_mil.Settings(encoded=4, attention=3, rounds=0))
    after = quality_mil.fit(x, rows, y.astype(float), settings)
    loss = lambda m: -np.mean(np.where(y == 1, np.log(p := quality_mil.forward(x, rows, m)[0]), np.log(1 - p)))
    for name in ("c", "b", "E", "e", "V", "U", "w"):
        moved = (after[name] - start[name]).ravel()
        for k in range(min(5, len(moved))):
            up, down = ({n: v.copy() for n, v in start.items()} for _ in range(2))
            up[name].ravel()[k] += 1e-5
            down[name].ravel()[k] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert abs(slope) < 1e-7 or np.sign(slope) == -np.sign(moved[k])


def test_attention_weights_sum_to_one():
    rng = np.random.default_rng(2)
    x, rows = rng.normal(size=(30, 6)), np.array([0, 1, 10, 30])
    model = quality_mil.fit(x, rows, np.array([0.0, 1.0, 0.0]), quality_mil.Settings(encoded=4, attention=3, rounds=5))
    weights = quality_mil.forward(x, rows, model)[1][4]
    assert np.allclose(np.add.reduceat(weights, rows[:-1]), 1)


def test_word_hashes_equal_iff_words_equal():
    raw = ["The the THE thé x  a".encode(), b"the\x0bthe\n\n", b""]
    data, starts = hashing.joined(raw)
    found, first, index = hashing.words(data, starts)
    assert index.tolist() == [0, 5, 7, 7] and len(set(found.tolist())) == 3
    assert len({found[k] for k in (0, 1, 2, 5, 6)}) == 1


def test_long_words_hash_whole():
    a, b = b"a" * 10_000 + b"x", b"a" * 10_000 + b"y"
    found, _, _ = hashing.words(*hashing.joined([a, b, a]))
    assert found[0] == found[2] != found[1]
