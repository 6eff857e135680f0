"""Suffix arrays against SQL and against plain search."""

import hashlib
import random
import re

import corpora
import numpy as np
import pytest
import sql
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthline.llm import suffixes
from hearthline.llm.suffixes import Settings, audited, clean, longest_matches, suffix_order


@pytest.mark.parametrize("sf_dir", [corpora.TINY, corpora.SMALL, "awkward", "nothing"])
def test_equals_its_sql(spark, request, sf_dir):
    sf_dir = sf_dir if sf_dir.startswith("/") else request.getfixturevalue(sf_dir)
    ours, theirs = sql.both(spark, suffixes.op13_suffix_arrays, suffixes.ORACLE, sf_dir)
    assert ours == theirs


def test_some_documents_are_hit(spark):
    rows = suffixes.op13_suffix_arrays(spark, corpora.SMALL).collect()
    hit = [r for r in rows if r["contaminated"]]
    assert 0 < len(hit) < len(rows) and max(r["longest"] for r in hit) > 20 and max(r["n_items"] for r in hit) >= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4))
def test_order_of_suffixes(texts):
    s = np.array([x for i, t in enumerate(texts) for x in [*(v + len(texts) for v in t), i]], np.int64)
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_order_of_one_word_many_times():
    s = np.array([1] * 20_000 + [0], np.int64)
    assert suffix_order(s).tolist() == list(range(20_000, -1, -1))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, window):
    """Per document: words in windows, item names, longest match."""
    out = []
    for _, text in docs:
        w, hit, names, longest = plain_words(text), set(), set(), 0
        for name, other in items:
            o = plain_words(other)
            n = min(window, len(o))
            for j in range(len(o) - n + 1) if o else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == o[j : j + n]:
                        hit |= set(range(k, k + n))
                        names.add("" if name is None else str(name))
                        m = n
                        while k + m < len(w) and j + m < len(o) and w[k + m] == o[j + m]:
                            m += 1
                        longest = max(longest, m)
        out.append((len(w), sorted(hit), sorted(names), longest))
    return out


def small(seed, n=60):
    deal = random.Random(seed)
    text = lambda size: " ".join(deal.choice("abAB1é") for _ in range(size))
    docs = [(i, text(deal.randrange(30))) for i in range(n)] + [(None, None), (3, ""), (4, "a, b; a-b"), (4, "a, b; a-b")]
    items = [(i % 9, text(deal.randrange(12))) for i in range(12)] + [(None, text(7)), (50, None)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [16 << 20, 40])
@pytest.mark.parametrize("shard_bytes", [4 << 20, 100])
def test_equals_plain_search_in_blocks_and_shards(spark, block_bytes, shard_bytes):
    docs, items = small(1)
    limits = Settings(window=4, block_bytes=block_bytes, shard_bytes=shard_bytes)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = audited(df, bench, limits).collect()
    ours = sorted((str(r["doc_id"]), r["n_words"], sorted({w for s in r["spans"] for w in range(s["first"], s["last"] + 1)}), sorted(r["items"]), r["longest"]) for r in found)
    theirs = sorted((str(d[0]), *p) for d, p in zip(docs, plain(docs, items, 4), strict=True))
    assert ours == theirs
    assert sum(1 for _ in suffixes.blocks(bench, limits)) > 1 or block_bytes > 40
    kept = clean(df.withColumn("longest", df.doc_id), bench, limits)
    assert kept.columns == ["doc_id", "text", "longest"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(i for i, *_, names, _ in theirs if not names)


def test_longest_matches_and_their_places(spark):
    docs, items = small(2)
    rows = longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Settings(window=3, shard_bytes=200)).collect()
    assert rows
    best = {}
    for name, other in items:
        o, label = plain_words(other), "" if name is None else str(name)
        for j in range(len(o)):
            need = 3 if len(o) - j >= 3 else len(o) if j == 0 else 99
            for doc_id, text in docs:
                w = plain_words(text)
                for k in range(len(w)):
                    m = 0
                    while k + m < len(w) and j + m < len(o) and w[k + m] == o[j + m]:
                        m += 1
                    if m >= need:
                        best.setdefault((label, j), []).append((-m, doc_id is None, doc_id or 0, k))
    least = {key: min(v) for key, v in best.items()}
    wanted = {(i, j, -v[0], v[2], v[3]) for (i, j), v in least.items() if (i, j - 1) not in least or -v[0] > -least[i, j - 1][0] - 1}
    assert {(r["item_id"], r["item_word"], r["n_words"], r["doc_id"], r["doc_word"]) for r in rows} == wanted


def test_digest_and_short_items(spark, tmp_path):
    sf = corpora.write(tmp_path, [(1, "x One two, three x ONE two three", "s"), (2, "one two", "s")], benchmark=[(10, "one two three"), (9, "two THREE"), (100, "x")])
    rows = {r["doc_id"]: r for r in suffixes.op13_suffix_arrays(spark, sf).collect()}
    assert rows[1]["n_items"] == 3 and rows[1]["items_sha256"] == hashlib.sha256(b"10,100,9").hexdigest()
    assert (rows[1]["n_hit"], rows[1]["n_words"], rows[1]["longest"]) == (8, 8, 3)
    assert (rows[2]["n_hit"], rows[2]["contaminated"], rows[2]["items_sha256"]) == (0, False, hashlib.sha256(b"").hexdigest())


def test_documents_are_not_shuffled(spark):
    assert "Exchange" not in corpora.plan(suffixes.op13_suffix_arrays(spark, corpora.TINY))
