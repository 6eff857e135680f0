"""Packing and piece encoding against the libraries and against bounds."""

import hashlib
import zlib
from collections import Counter

import corpora
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearthline.llm import packing, pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
OWN = pieces.Pieces()


def check_pieces(text: str) -> None:
    ids, n, decoded = OWN.whole(text)
    expected = LIBRARY.encode(text)
    assert [int(i) for i in ids.split(",")] == expected if n else expected == []
    assert n == len(expected) and decoded.decode() == LIBRARY.decode(expected)


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60))
def test_pieces_of_any_text(text):
    check_pieces(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abehinst \n\t.,#▁éß日0123", max_size=80))
def test_pieces_of_texts_that_merge_much(text):
    check_pieces(text)


@pytest.mark.parametrize("text", [" " * k for k in range(40)] + ["a" * k for k in (50, 500)] + ["#" * 300, "²." * 9, "<s></s><unk><0x41>", "\x00", "ﬁ Ａ　x"])
def test_pieces_of_runs_and_marks(text):
    check_pieces(text)


def test_pieces_query_equals_the_library(spark):
    rows = pieces.op9_pieces(spark, corpora.SMALL).toPandas().set_index("doc_id")
    docs = corpora.documents(corpora.SMALL)
    assert len(rows) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = LIBRARY.encode(text)
        r = rows.loc[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


TOKENIZER = Tokenizer.from_file(packing.VOCABULARY)
TOKENIZER.encode_special_tokens = True


def plain_ids(text: str) -> list[int]:
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_fast_ids_equal_the_tokenizer(text):
    assert packing.Ids.get().of(text) == plain_ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|> x", " " * 3000, "a" * 30_000, "\n\n  \t x's we'll 1234567 ###", "日本語 é́   "])
def test_fast_ids_of_odd_texts(text):
    assert packing.Ids.get().of(text) == plain_ids(text)


def best_fit_decreasing(counts: Counter, room: int) -> int:
    rooms, used = Counter(), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            spot = next((c for c in range(length, room + 1) if rooms[c]), None)
            if spot is None:
                used, spot = used + 1, room
            else:
                rooms[spot] -= 1
            rooms[spot - length] += 1
    return used


LENGTHS = {
    "uniform": lambda r: r.integers(1, 1025, 6000),
    "halves": lambda r: r.integers(300, 700, 6000),
    "one": lambda r: np.full(999, 400),
    "two": lambda r: np.r_[np.full(1000, 600), np.full(900, 424)],
    "thirds": lambda r: r.integers(341, 343, 3000),
    "few": lambda r: np.array([5, 7, 1024]),
    "hot": lambda r: np.r_[np.full(3000, 513), r.integers(1, 1025, 3000)],
    "small": lambda r: r.integers(1, 30, 5000),
}


@pytest.mark.parametrize("name", sorted(LENGTHS))
def test_a_plan_places_everything_tightly(name):
    counts = Counter(LENGTHS[name](np.random.default_rng(5)).tolist())
    runs = packing.plan(dict(counts))
    placed = Counter()
    for run in runs:
        assert run.count > 0 and sum(run.lengths) <= 1024
        for length in run.lengths:
            placed[length] += run.count
    assert placed == counts
    used = sum(run.count for run in runs)
    bound = -(-sum(k * v for k, v in counts.items()) // 1024)
    assert bound <= used <= 1.004 * best_fit_decreasing(counts, 1024) + 1
    spots, sequences = packing.places(runs)
    assert sequences == used and len(spots) < 20_000


def test_groups_are_of_equal_cardinality_and_round_up():
    counts = {n: 7 for n in range(341, 1025)}
    groups = packing.sizes_of_groups(counts, 100)
    assert len(groups) == 100 and all(size == held[0][0] for size, held in groups)
    sizes = [sum(c for _, c in held) for _, held in groups]
    assert sum(sizes) == 7 * 684 and max(sizes) - min(sizes) <= 1


def test_packing_query(spark):
    rows = packing.op3_packing(spark, corpora.SMALL).toPandas()
    docs = corpora.documents(corpora.SMALL)
    own = dict(tuple(rows.sort_values("piece").groupby("doc_id")))
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*plain_ids(text), 2], "<u4")
        found = own[i]
        assert found.piece.tolist() == list(range(len(found))) and found.length.sum() == len(ids)
        assert found.start.tolist() == [0, *found.length.cumsum()[:-1]] and (found.length[1:] == 1024).all()
        for start, length, crc in zip(found.start, found.length, found.ids_crc32, strict=True):
            assert zlib.crc32(ids[start : start + length]) == crc
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]] and sequence.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= 1.01 * rows.length.sum() / 1024 + 2


def test_lengths_stand_in_a_table_and_not_in_the_plan(spark):
    """A literal per length, in every copy that the driver makes of a plan, took its memory."""
    rows = packing.op3_packing(spark, corpora.TINY)
    assert rows._jdf.queryExecution().analyzed().toJSON().count("expressions.Literal") < 100
