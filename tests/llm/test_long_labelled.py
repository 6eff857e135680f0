"""The fits see whole texts: what marks a label may stand at either end of a long one."""

import weakref
import zlib

import corpora
import numpy as np
import pytest

from hearthline.llm import quality_mil, toxicity

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa"]
MARK = {"toxic": "vile idiot scum " * 5, "quality": "$$$ ### %%% &&& " * 48}


@pytest.mark.parametrize("place", ["start", "end"])
@pytest.mark.parametrize(("query", "label", "modulus", "held"), [(toxicity.op10_toxicity, "toxic", 4, 2), (quality_mil.op2_quality, "quality", 5, 0)])
def test_marks_at_the_ends_of_long_texts_are_learnt(spark, tmp_path, query, label, modulus, held, place):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(160):
        marked = i % 2
        body = " ".join(rng.choice(WORDS, 3600 if marked else 60))  # marked ones: about 20,000 characters
        mark = MARK[label] if marked else ""
        rows.append((i, mark + body if place == "start" else body + " " + mark, "s"))
        labels.append((i, 1 - marked, marked))
    # plain texts of the same length: the length alone tells nothing
    for i in range(160, 240):
        rows.append((i, " ".join(rng.choice(WORDS, 3600)), "s"))
        labels.append((i, 1, 0))
    found = query(spark, corpora.write(tmp_path, rows, labels=labels)).toPandas().set_index("doc_id")
    y = np.array([t if label == "toxic" else q for _, q, t in labels])
    out = np.array([zlib.crc32(str(i).encode()) % modulus == held for i in range(len(rows))])
    assert 20 < out.sum() and (found.held_out.loc[range(len(rows))] == out).all()
    assert (found.predicted.loc[range(len(rows))].to_numpy()[out] == y[out]).mean() > 0.95


@pytest.mark.parametrize("n", [0, 1, 8191, 8192, 100_000, 1 << 18])
def test_feature_numbers_travel_whole(n):
    found = np.random.default_rng(n).permutation(1 << 18)[:n].astype(np.int32)
    written = toxicity._written(found, 18)
    assert len(written) <= 1 << 15 and np.array_equal(toxicity._read(written, 18), np.sort(found))


def test_the_driver_reads_a_texts_features_when_it_needs_them(spark, monkeypatch):
    alive, most, read = [0], [0], toxicity._read

    def gone():
        alive[0] -= 1

    def watched(written, bits):
        found = read(written, bits)
        weakref.finalize(found, gone)
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        return found

    monkeypatch.setattr(toxicity, "_read", watched)
    docs, labels = (spark.read.parquet(f"{corpora.SMALL}/{name}.parquet") for name in ("documents", "labels"))
    weights, _ = toxicity.train(spark, docs, labels.select("doc_id", "toxic"))
    assert weights.any() and 0 < most[0] < 5
