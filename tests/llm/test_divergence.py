"""Divergences against SQL and plain Python; skybands against counting."""

import random

import corpora
import numpy as np
import pyarrow as pa
import pytest
import sql

from hearthline.llm import divergence
from hearthline.llm.divergence import Settings, counts, divergences, leading_terms, pair_divergences, skyband, skybands


@pytest.mark.parametrize("sf_dir", [corpora.SMALL, "awkward", "nothing"])
def test_equals_its_sql(spark, request, sf_dir):
    sf_dir = sf_dir if sf_dir.startswith("/") else request.getfixturevalue(sf_dir)
    ours, theirs = sql.both(spark, divergence.op11_divergence, divergence.ORACLE, sf_dir)
    assert ours == theirs


def dominated(n, lang_n, term):
    above = (n[None] >= n[:, None]) & (lang_n[None] <= lang_n[:, None]) & (term[None] < term[:, None])
    return above.sum(1)


@pytest.mark.parametrize("top", [1, 3, 40])
@pytest.mark.parametrize("values", [4, 50])
def test_skyband_equals_counting(top, values):
    deal = np.random.default_rng(top + values)
    n, lang_n = deal.integers(1, values, 1500), deal.integers(1, values, 1500)
    term = deal.permutation(1500)
    assert sorted(skyband(n, lang_n, term, top).tolist()) == np.flatnonzero(dominated(n, lang_n, term) < top).tolist()


def test_skybands_of_parts_hold_the_leading_terms(spark, monkeypatch):
    """Groups meet in one partition, buffers are small, and names that join to the same string stay apart."""
    deal = random.Random(3)
    rows = [(a, b, f"t{i}", deal.randrange(1, 9), deal.randrange(9, 30)) for a, b in (("", "x y"), ("x", "y"), (" x", "y")) for i in range(300)]
    band = skybands(spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long").coalesce(1), 5).collect()
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        names = np.argsort(np.argsort([r[2] for r in own]))
        stays = dominated(np.array([r[3] for r in own]), np.array([r[4] for r in own]), names) < 5
        assert sorted(r["term"] for r in band if (r["lang"], r["source"]) == key) == sorted(r[2] for r, s in zip(own, stays, strict=True) if s)


def test_divergences_equal_the_definition():
    deal = np.random.default_rng(2)
    have = deal.random((6, 40)) < 0.4
    have[4] = False
    absent = deal.integers(1, 50, 6)
    p = np.where(have, deal.integers(51, 10**9, (6, 40)), absent[:, None])
    source, term = np.nonzero(have)
    wanted = [[sum((a - b) ** 2 // b for a, b in zip(p[i].tolist(), p[j].tolist(), strict=True)) for j in range(6)] for i in range(6)]
    assert divergences(source, term, p[have], absent, 40).tolist() == wanted


def test_shares_are_exact_and_take_decimals_for_large_counts_only(spark):
    deal = random.Random(6)
    edges = [0, 1, divergence.WIDE - 1, divergence.WIDE, 10 * divergence.WIDE, 10**17]
    rows = [(n, n + deal.randrange(10**deal.randrange(1, 17)), deal.randrange(1, 10**9)) for n in [*edges, *(deal.randrange(10**11) for _ in range(200))]]
    found = spark.createDataFrame(rows, "n long, size long, terms long").select("n", "size", "terms", divergence.share("n", "size").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["size"] + r["terms"]) for r in found) and len(found) == len(rows)


def test_cells_are_counted_with_one_sort_and_without_a_join(spark, monkeypatch):
    written = []
    monkeypatch.setattr(divergence, "keep", lambda df: written.append(corpora.plan(df)) or df)
    counts(spark.read.parquet(f"{corpora.TINY}/documents.parquet"))
    assert "Join" not in written[0] and written[0].count("Exchange hashpartitioning") == 2 and written[0].count("+- Sort [") == 1


def plain(docs, least=3, top=200):
    import re
    from collections import Counter

    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    rows = [(a or "", b or "", split(t)) for a, b, t in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        held = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, k in held.items() if k >= least)
        names = sorted({r[1] for r in own})
        count = {s: Counter(t for r in own if r[1] == s for t in r[2]) for s in names}
        count[None] = sum((count[s] for s in names), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept} for s, c in count.items()}
        for s in names:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in names if o != s]
            terms = [((p[s][t] - p[None][t]) ** 2 // p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top}
    return out


def test_equals_plain_python_in_small_blocks(spark, monkeypatch):
    deal = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "é", "ß", "ZZ", "zz"]
    docs = [(deal.choice(["en", "de", None]), deal.choice(["s1", "s2", "s3", None]), " ".join(deal.choice(words) for _ in range(deal.randrange(40)))) for _ in range(120)]
    docs += [("xx", "only", "a b"), ("yy", "one", "rare"), ("yy", "two", None), ("yy", "three", "1 2 3")]
    limits = Settings(top=7, salts=(4, 1), block=50)
    found = counts(spark.createDataFrame(docs, "lang string, source string, text string"), limits)
    ours = {("pair", *r) for r in pair_divergences(found, limits).collect()} | {("term", *r) for r in leading_terms(found, limits).collect()}
    assert {(a, b, part, item, v, rank) for part, a, b, item, v, rank in ours} == plain(docs, top=7)


def test_buffers_are_given_out_when_full(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    batch = pa.table({"lang": ["a"] * 50, "source": ["b"] * 50, "term": [f"{i:02}" for i in range(50)], "n": [1] * 50, "lang_n": [3] * 50})
    assert divergence._banded(batch, 4).column("term").to_pylist() == ["00", "01", "02", "03"]


def test_no_term_is_gathered_before_it_is_combined(spark):
    found = divergence.counted(spark.read.parquet(f"{corpora.TINY}/documents.parquet"))
    lines = corpora.plan(found).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert "partial_sum" in lines[exchange + 1]
