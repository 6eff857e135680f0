"""Packing's ids against the tokenizer as its file gives it, on texts with its added tokens."""

import zlib

import corpora
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearthline.llm import packing

TOKENIZER = Tokenizer.from_file(packing.VOCABULARY)
END = "<|endoftext|>"
TEXTS = ["", END, f"a {END} b", f"{END}{END} x  {END}", f"two  \n {END}\n\n ends here{END}", f"<|endoftext {END}|>", f"{END} " + "a" * 3000, f"é {END} 日本"]


def library(text: str) -> list[int]:
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_the_added_token_is_one_id():
    assert packing.Ids.get().whole(f"a {END} b") == [64, 220, 50256, 275]


@pytest.mark.parametrize("text", [*TEXTS, " " * 100_000 + END])
def test_ids_equal_the_unmodified_tokenizer(text):
    assert packing.Ids.get().whole(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([END, "<|", "endoftext", "|>", " ", "\n", "  ", "a", "b's", "12", "é", "#"]), max_size=12).map("".join))
def test_ids_of_texts_around_the_added_token(text):
    assert packing.Ids.get().whole(text) == library(text)


def test_packed_pieces_hold_the_tokenizer_s_ids(spark, tmp_path):
    texts = [*TEXTS, f"some words {END} " * 700]
    sf = corpora.write(tmp_path, [(k, x, "s") for k, x in enumerate(texts)])
    rows = packing.op3_packing(spark, sf).toPandas()
    for i, found in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array([*library(texts[i]), 2], "<u4")
        assert found.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n]) for a, n in zip(found.start, found.length, strict=True)] == found.ids_crc32.tolist()
    assert rows.doc_id.nunique() == len(texts)
