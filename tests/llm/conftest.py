import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpora  # noqa: E402


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    """Missing, empty, long and repeated rows, and columns whose names the operators use."""
    labels = [(1, 1, 0), (2, 0, 1), (6, 1, 0), (7, None, None), (8, 1, 0), (None, 1, 1), (11, 0, 1), (6, 1, 0)]
    pages = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (None, "v", "é"), (3, "w", "z" * 100_000)]
    benchmark = [(1, corpora.LINE), (1, corpora.LINE), (2, None), (3, ""), (4, "One"), (None, "word7 word8"), (5, "A text without AN id that, is long enough; to have it"), (60, "word9 " * 12)]
    return corpora.write(tmp_path_factory.mktemp("awkward"), corpora.AWKWARD, True, labels, pages, benchmark, corpora.VECTORS)


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    return corpora.write(tmp_path_factory.mktemp("nothing"), [])
