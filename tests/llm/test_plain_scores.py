"""The two trained scorers against plain recomputations, text by text."""

import math
import re

import corpora
import numpy as np
import pytest

from hearthline.llm import hashing, quality_mil, toxicity

TEXTS = [
    "", " \n\t ", "one", "  leading blanks and Words", "naïve café 日本語 日本語", "spam! " * 200, "\n\nA line.\nA line.\nAnother one, 12%",
    " ".join(f"word{i % 50}" for i in range(700)), "end\n\n", "\tx", "y" * 5000 + " y",
]


def grams(text: str) -> set[str]:
    clean = " " + re.sub(r"[ \t-\r]+", " ", text).strip(" ") + " "
    clean = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in clean)
    return set() if len(clean) <= 2 else {clean[i : i + n] for n in (3, 4, 5) for i in range(len(clean) - n + 1)}


def test_features_are_the_grams_of_characters():
    """As many as there are distinct ones, and shared as they are (22 bits: no two of these few meet by chance)."""
    found = [set(x.tolist()) for x in toxicity.features([t.encode() for t in TEXTS], 22)]
    plain = [grams(t) for t in TEXTS]
    assert [len(x) for x in found] == [len(x) for x in plain]
    assert len(toxicity.features(["日本語".encode()], 22)[0]) == 3 + 2 + 1
    for a in range(len(TEXTS)):
        for b in range(a):
            assert len(found[a] & found[b]) == len(plain[a] & plain[b])


def test_scores_equal_a_plain_fit():
    """Ratios counted over sets of strings, and the penalised loss brought to rest by dense Newton steps."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["good", "fine", "日本", "Calm", "plain"], 6)) for _ in range(80)]
    labels = [int(k % 4 == 0) for k in range(80)]
    texts = [t + (" awful" if y and k % 8 else "") for k, (t, y) in enumerate(zip(texts, labels, strict=True))]
    settings = toxicity.Settings(bits=22)
    weights, intercept = toxicity.fit([t.encode() for t in texts], labels, settings)
    sets, y = [grams(t) for t in texts], np.array(labels, float)
    names, ratios = [], []
    for name in sorted(set().union(*sets)):
        p = sum(name in s for s, label in zip(sets, labels, strict=True) if label)
        q = sum(name in s for s, label in zip(sets, labels, strict=True) if not label)
        ratio = math.log((1 + p) / (1 + sum(labels))) - math.log((1 + q) / (1 + len(labels) - sum(labels)))
        if p + q >= settings.least_texts and abs(ratio) > settings.least_ratio:
            names.append(name)
            ratios.append(ratio)
    x = np.array([[r * (name in s) for name, r in zip(names, ratios, strict=True)] + [1.0] for s in sets])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = np.append(np.full(len(names), settings.penalty), 0.0)
    w = np.zeros(len(names) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
    asked = [*texts, "awful 日本", "nothing known"]
    found = toxicity.probabilities([t.encode() for t in asked], weights, intercept, settings.bits)
    for text, score in zip(asked, found, strict=True):
        held = grams(text)
        z = w[-1] + sum(a * r for a, r, name in zip(w, ratios, names, strict=False) if name in held)
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3)


def test_a_fit_that_does_not_rest_warns():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a1", "b2", "c3", "d4"], 5)) + " bad" * (k % 2) for k in range(60)]
    with pytest.warns(RuntimeWarning, match="come to rest"):
        toxicity.fit([t.encode() for t in texts], [k % 2 for k in range(60)], toxicity.Settings(steps=1))


# quality


def plain_passages(text: str, size: int) -> list[list[float]]:
    """A row per passage from the definitions, but for the words' hashes."""
    raw = text.encode() + b" "
    at = [m.start() for m in re.finditer(rb"[^ \t-\r]+", raw)]
    words = [m.group().decode().translate({c: c + 32 for c in range(65, 91)}) for m in re.finditer(rb"[^ \t-\r]+", raw)]
    if not words:
        return [[0.0] * quality_mil.WIDTH]
    hashed = hashing.words(*hashing.joined([text.encode()]))[0].tolist()
    out = []
    for k in range(0, len(words), size):
        mine = words[k : k + size]
        a, b = (at[k] if k else 0), (at[k + size] if k + size < len(at) else len(raw))
        kinds = [int(quality_mil._CLASS[c]) for c in raw]
        row = [sum(kinds[i] == c for i in range(a, b)) / (b - a) for c in range(9)]
        pairs = [(kinds[i - 1], kinds[i]) for i in range(max(a, 1), b)]
        row += [pairs.count((c, d)) / (b - a) for c in range(9) for d in range(9)]
        bucket = [h >> 58 for h in hashed[k : k + size]]
        row += [math.sqrt(bucket.count(c) / len(mine)) for c in range(64)]
        row += [sum(mine[i] == mine[i - back] for i in range(back, len(mine))) / len(mine) for back in (1, 2)]
        ends = [*at[1:], len(raw)]
        row.append(sum(min(ends[i] - at[i], 40) / 40 for i in range(k, k + len(mine))) / len(mine))
        row += [len(mine) / size, len(set(mine)) / len(mine)]
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else []
        row.append(sum(triples[i] in triples[:i] for i in range(k, min(k + len(mine), len(triples)))) / len(mine))
        out.append(row)
    return out


def test_passages_equal_their_definition_beside_any_other_texts():
    raw = [t.encode() for t in TEXTS]
    x, rows = quality_mil.passages(raw, 64)
    for k, text in enumerate(TEXTS):
        plain = plain_passages(text, 64)
        assert np.allclose(x[rows[k] : rows[k + 1]], plain, atol=1e-6), text[:20]
    turned, back = quality_mil.passages(raw[::-1], 64)
    for k in range(len(raw)):
        j = len(raw) - 1 - k
        assert np.array_equal(x[rows[k] : rows[k + 1]], turned[back[j] : back[j + 1]])


def test_a_score_equals_a_plain_pass_of_the_model():
    rng = np.random.default_rng(6)
    x, rows = quality_mil.passages([t.encode() for t in TEXTS], 64)
    model = quality_mil.fit(x, rows, np.arange(len(TEXTS)) % 2.0, quality_mil.Settings(rounds=3))
    model["c"] = rng.normal(size=model["c"].shape)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    found = quality_mil.scores([t.encode() for t in TEXTS], model, 64)
    for text, score in zip(TEXTS, found, strict=True):
        hidden, raised = [], []
        for row in plain_passages(text, 64):
            scaled = [(v - m) / s for v, m, s in zip(row, model["mean"], model["spread"], strict=True)]
            h = [math.tanh(e + sum(v * w for v, w in zip(scaled, column, strict=True))) for e, column in zip(model["e"], model["E"].T, strict=True)]
            gate = [
                math.tanh(sum(a * b for a, b in zip(h, v, strict=True))) * sigmoid(sum(a * b for a, b in zip(h, u, strict=True)))
                for v, u in zip(model["V"].T, model["U"].T, strict=True)
            ]
            hidden.append(h)
            raised.append(math.exp(sum(a * b for a, b in zip(gate, model["w"], strict=True))))
        pooled = [sum(a * h[j] for a, h in zip(raised, hidden, strict=True)) / sum(raised) for j in range(len(hidden[0]))]
        assert score == pytest.approx(sigmoid(model["b"][0] + sum(a * b for a, b in zip(pooled, model["c"], strict=True))), abs=1e-5)


def test_passages_of_the_fit_are_bounded(spark):
    assert quality_mil.fitting([(1, 0, 5), (2, 0, 6), (3, 1, 9), (4, 0, 4), (5, 1, 2), (6, 1, 1)], 10) == [1, 3, 4, 6]
    docs, labels = (spark.read.parquet(f"{corpora.TINY}/{name}.parquet") for name in ("documents", "labels"))
    for bound in (0, 100):
        model = quality_mil.train(docs, labels, quality_mil.Settings(passages=bound, rounds=2))
        assert np.isfinite(quality_mil.scores([b"some words"], model, 64)).all()
