"""Near duplicates against all pairs."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import corpora
import numpy as np
import pytest

from hearthline.llm import near_dedup
from hearthline.llm.components import components
from hearthline.llm.near_dedup import Settings

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows: list[tuple], size: int, percent: int) -> dict:
    """doc_id: (n_shingles, component_id)"""
    sets = [shingles(x, size) for _, x, *_ in rows]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for one in own:
            holders[one].append(k)
    common = Counter()
    for held in holders.values():
        common.update(combinations(held, 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[root(k)].append(i)
    return {i: (len(sets[k]), min(least[root(k)])) for k, (i, *_) in enumerate(rows)}


def found(spark, rows: list[tuple], settings: Settings) -> dict:
    docs = spark.createDataFrame([(i, x) for i, x, *_ in rows], "doc_id long, text string")
    out = near_dedup.classes(docs, settings).collect()
    assert len(out) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def test_query_against_all_pairs(spark):
    docs = corpora.documents(corpora.TINY)
    rows = list(zip(docs.doc_id, docs.text, strict=True))
    out = near_dedup.op7_near_dedup(spark, corpora.TINY).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, 3, 85)


def variants(rng, count: int, edits: tuple[int, int], first: int, words: int = 150) -> list[tuple]:
    base = [f"w{rng.integers(1e9)}" for _ in range(words)]
    rows = [(first, " ".join(base))]
    for k in range(1, count):
        own = list(base)
        for at in rng.choice(words, int(rng.integers(*edits)), replace=False):
            own[at] = f"x{rng.integers(50)}"
        rows.append((first + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("edits", [(1, 3), (3, 6), (1, 9)])
def test_large_groups_of_near_copies(spark, edits):
    """Most of them are linked through the original alone, or not at all."""
    rng = np.random.default_rng(6)
    rows = variants(rng, 250, edits, 0) + variants(rng, 2, (1, 2), 1000) + [(2000 + k, rows_text) for k, rows_text in enumerate(["same text here"] * 40)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    for settings in (Settings(shingle=3, percent=85), Settings(shingle=3, percent=85, crowd=16, block=3000)):
        assert found(spark, rows, settings) == brute(rows, 3, 85)


def test_five_words_and_four_fifths_by_default(spark):
    rng = np.random.default_rng(7)
    rows = variants(rng, 30, (1, 4), 0) + variants(rng, 30, (2, 7), 100, 300)
    assert found(spark, rows, Settings()) == brute(rows, 5, 80)


def test_lines_that_many_documents_share_link_nothing(spark):
    rng = np.random.default_rng(8)
    line = " ".join(f"common{k}" for k in range(20))
    rows = [(k, line + " " + " ".join(f"w{rng.integers(1e9)}" for _ in range(30))) for k in range(300)]
    assert found(spark, rows, Settings(shingle=3, percent=85)) == {i: (48, i) for i, _ in rows}


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(9)
    path = [(k, k + 1) for k in rng.permutation(60)]
    star = [(1000, 1000 + k) for k in range(1, 80)]
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in [*path, *star, *star, (7, 7), (5000, 5000)]], "a long, b long")
    labels = {r["id"]: r["label"] for r in components(edges).collect()}
    assert labels == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(80)}
    assert components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1_000_000, 20_000])
def test_pages_of_a_template_below_the_threshold(spark, block):
    """170 of 200 words alike: every page is a class of its own, but for three that are really alike."""
    rng = np.random.default_rng(10)
    frame = [f"common{k}" for k in range(170)]
    rows = [(k, " ".join(frame + [f"w{rng.integers(1e9)}" for _ in range(30)])) for k in range(240)]
    rows += [(1000, rows[5][1] + " more"), (1001, "less " + rows[5][1]), (1002, rows[7][1][:-3] + "zzz")]
    settings = Settings(shingle=3, percent=85, block=block)
    assert found(spark, rows, settings) == brute(rows, 3, 85)


def test_rare_pairs_hold_every_similar_pair(spark):
    rng = np.random.default_rng(11)
    words = [f"t{k}" for k in range(300)]  # few words, so that shingles of one word are shared by many
    sets = [sorted(set(rng.choice(words, 40, replace=False)) | {f"own{i // 2}"}) for i in range(80)]
    for i in range(0, 80, 2):
        sets[i + 1] = sorted(set(sets[i][2:]) | {f"other{i}"})
    raw = [np.unique(np.array([hash_of(w) for w in s], "<u8")) for s in sets]
    rows = [(b"g", bytes([i]), bytes([i]), i % 3 > 0, s.tobytes()) for i, s in enumerate(raw)]
    df = spark.createDataFrame(rows, "hub binary, id binary, label binary, outer boolean, shingles binary")
    pairs = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in near_dedup.rare_pairs(df, Settings(percent=85)).collect()}
    alike = {(i, j) for i, j in combinations(range(80), 2) if 100 * (c := len(np.intersect1d(raw[i], raw[j]))) >= 85 * (len(raw[i]) + len(raw[j]) - c)}
    assert len(alike) >= 40 and {p for p in alike if p[0] % 3 or p[1] % 3} <= pairs
    assert len(pairs) < 80 * 79 / 4


def hash_of(word: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def test_rarest_shingles_that_must_be_shared():
    assert [near_dedup.spare(n, 85) for n in (1, 6, 7, 20, 100)] == [1, 1, 2, 4, 16]
