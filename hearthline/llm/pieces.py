"""SentencePiece BPE encoding from a table of each prefix's last piece.

In a merge-type encoding every prefix of a text has exactly one last piece, and a sequence is the
encoding iff each two neighbours stay apart when their joined string is merged. So the table is filled
left to right: an automaton gives the pieces that end at a place, and the one that is compatible with
the last piece of the prefix before it is stored. The ids are read off backwards from the end.

No piece holds a blank mark after another character, or letters beside other characters, so a text falls
apart at such borders and equal stretches are encoded once per worker; a vocabulary with other pieces is
refused. A character without a piece stands alone and becomes its bytes.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm.tables import mapped, table, texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The mark that stands for a blank in pieces.
BLANK = "▁"
#: Blanks and the letters, or else the other characters (raised digits too), that follow them.
_STRETCH = re.compile(f"{BLANK}*(?:[^\\W\\d_¹²³]+|(?:(?!{BLANK})[\\W\\d_¹²³])+)|{BLANK}+")
#: Stretches that a worker remembers of late; twice as many are held, those not met again go.
REMEMBERED = 400_000


class Pieces:
    """The vocabulary of a model, read once; ids, scores and kinds come from the library, the encoding does not."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(names))]
        self.names = names
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        value = {i: bytes((b,)) for b, i in self.byte.items()}
        self.shown = [value.get(i) or n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.digits = [str(i) for i in range(len(names))]
        self.ids = {n: i for i, n in enumerate(names) if not special[i]}
        self.score = [model.get_score(i) for i in range(len(names))]
        if any(len(_STRETCH.findall(n)) > 1 for n in self.ids):
            raise ValueError("a piece reaches over a border of stretches; texts can't be cut there")
        #: The two pieces that the last merge of a piece joins; None for single characters.
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(name) == 1:
                self.halves[i] = None
            elif (made := self._last_merge(name)) is not None:
                self.halves[i] = made
            else:
                continue  # no sequence of merges ends in it
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}
        self.size = [len(n) for n in names]
        self.single = frozenset(n for n in self.ids if len(n) == 1)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def _last_merge(self, name: str) -> tuple[int, int] | None:
        """By merging: the best score first, of equal scores the leftmost."""
        parts = list(name)
        while len(parts) > 2:
            found = [(-self.score[i], k) for k, (a, b) in enumerate(pairwise(parts)) if (i := self.ids.get(a + b)) is not None]
            if not found:
                return None
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        a, b = self.ids.get(parts[0]), self.ids.get(parts[1])
        return None if a is None or b is None else (a, b)

    def compatible(self, left: int, right: int) -> bool:
        """Do the two pieces stay two pieces when their joined characters are merged?

        The merges that made them are undone from the latest on. At each stage the pieces at the border
        could have been joined instead if that has a better score than the merge undone last; of equal
        scores the merge further left comes first.
        """
        key = left * len(self.names) + right
        known = self.apart.get(key)
        if known is not None:
            return known
        score, names, halves, ids = self.score, self.names, self.halves, self.ids
        a, b = left, right
        after: tuple[float, int] | None = None  # score and side (0 left, 1 right) of the merge undone last
        result = True
        while True:
            across = ids.get(names[a] + names[b])
            if across is not None:
                s = score[across]
                if after is None or s > after[0] or s == after[0] and after[1] == 1:
                    result = False
                    break
            ha, hb = halves[a], halves[b]
            if ha is None and hb is None:
                break
            if hb is None or ha is not None and score[a] < score[b]:
                after, a = (score[a], 0), ha[1]
            elif ha is None or score[b] < score[a]:
                after, b = (score[b], 1), hb[0]
            else:  # equal scores: the right one was made last
                after, b = (score[b], 1), hb[0]
        if len(self.apart) < 1_500_000:
            self.apart[key] = result
        return result

    def encode(self, text: str) -> list[int]:
        """The ids of a stretch. Characters without a piece part it: nothing is ever merged with them."""
        if self.single.issuperset(text):
            return self._backwards(text)
        out: list[int] = []
        begin = 0
        for k, one in enumerate(text):
            if one not in self.single:
                out += self._backwards(text[begin:k]) if begin < k else []
                out += (self.byte[x] for x in one.encode())
                begin = k + 1
        return out + self._backwards(text[begin:]) if begin < len(text) else out

    def _backwards(self, text: str) -> list[int]:
        """Fill the table of last pieces (0: not found yet), then recover the ids from its end."""
        last = [0] * (len(text) + 1)
        width, apart, size = len(self.names), self.apart, self.size
        for at, piece in self.automaton.iter(text):
            end = at + 1
            if last[end]:
                continue
            before = last[end - size[piece]]
            if not before:  # the first piece: a prefix that is not empty has a last piece already
                last[end] = piece
                continue
            fits = apart.get(before * width + piece)
            if fits is None:
                fits = self.compatible(before, piece)
            if fits:
                last[end] = piece
        out = []
        end = len(text)
        while end:
            out.append(last[end])
            end -= size[last[end]]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a stretch's ids, blanks restored."""
        return b"".join([self.shown[i] for i in ids])

    def _learn(self, text: str) -> tuple[str, int, bytes]:
        """A stretch's ids as decimal numbers joined by commas, their number, and what they decode to."""
        found = self.older.get(text)
        if found is None:
            ids = self.encode(text)
            found = (",".join([self.digits[i] for i in ids]), len(ids), self.decode(ids))
        if len(text) < 40:
            self.known[text] = found
        return found

    def whole(self, text: str) -> tuple[str, int, bytes]:
        """The same of a whole text, with the blank that the model puts in front and decoding takes off."""
        if not text:
            return "", 0, b""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        stretches = _STRETCH.findall(BLANK + text.replace(" ", BLANK))
        parts = list(map(self.known.get, stretches))
        if None in parts:
            parts = [x or self.known.get(y) or self._learn(y) for x, y in zip(parts, stretches, strict=True)]
        ids, counts, decoded = zip(*parts, strict=True)
        return ",".join(ids), sum(counts), b"".join(decoded)[1:]


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One per worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids (array), decoded (text) per row: the operator's whole output. A missing text is empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [loaded(path).whole(x) for x in texts(batch)]
        ids = pa.array([[int(i) for i in x[0].split(",")] if x[1] else [] for x in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([x[2].decode() for x in found])], ["doc_id", "ids", "decoded"])

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; ids and decoded text stay inside the task."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [loaded(path).whole(x) for x in texts(batch)]
        columns = [
            batch.column("doc_id"),
            pa.array([x[1] for x in found], pa.int64()),
            pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in found], pa.string()),
            pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's encoding and its decoding, as digests.

    Empty and missing texts have no ids; repeated rows and missing doc_ids get a row each.
    """
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
