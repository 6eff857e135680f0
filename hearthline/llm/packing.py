"""Packing tokenised documents into few sequences by linear grouping and best fit.

A document's ids are cut into pieces of `room` tokens; its first piece may be shorter and is the only one
that shares a sequence. The number of first pieces of each length is all that the plan needs: at most
`room` numbers, whatever the corpus. From them it is made on the driver:

1. Lengths over `small` are ordered and put into groups of equal cardinality; each is rounded up to its
   group's longest, which leaves few sizes.
2. Configurations of those sizes are optimised as a cutting-stock programme (columns made by a knapsack),
   and rounded down to whole numbers.
3. The actual lengths take the places of their group's size, longest first.
4. What is left of the large ones, then the small ones from long to short, go where they fit best.

The plan is a list of runs: "documents lo..hi of this length lie at this offset of consecutive sequences". Tasks
number the documents of each length and look their place up.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthline.llm.tables import keep, mapped, table, texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, without its added tokens: equal ids in a fifth of the time (a test compares them).
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass(frozen=True)
class Settings:
    """`rows`: documents that one numbering group may hold, about, if a third of all have one length."""

    room: int = 1024
    end: int = 2
    small: int = 340
    groups: int = 512
    rows: int = 50_000


class Ids:
    """Token ids of a text, once per worker."""

    _loaded: Ids | None = None

    def __init__(self) -> None:
        with open(RANKS, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain: Tokenizer | None = None
        with open(VOCABULARY, encoding="utf-8") as whole:
            self.added = {x["content"]: x["id"] for x in json.load(whole)["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    @classmethod
    def get(cls) -> Ids:
        if cls._loaded is None:
            cls._loaded = cls()
        return cls._loaded

    def whole(self, text: str) -> list[int]:
        """The tokenizer's ids: strings of its added tokens are these tokens, what lies between them is ordinary."""
        ids: list[int] = []
        for part in self.parts.split(text):
            ids += [self.added[part]] if part in self.added else self.of(part)
        return ids

    def of(self, text: str) -> list[int]:
        """Ids of ordinary text, which strings of added tokens are here as well."""
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as failed:  # its pattern library gives up on very long runs without a break
            if type(failed).__name__ != "PanicException":
                raise
        if self.plain is None:
            self.plain = Tokenizer.from_file(VOCABULARY)
            self.plain.encode_special_tokens = True
        return self.plain.encode(text, add_special_tokens=False).ids


def tokenised(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, ordinal (of the row in its task), first (length of the first piece), crcs (of each piece's ids)."""
    room = settings.room

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, crcs = [], []
        for text in texts(batch):
            ids = np.array([*Ids.get().whole(text), settings.end], "<u4")
            head = (len(ids) - 1) % room + 1
            first.append(head)
            crcs.append([zlib.crc32(ids[:head]), *(zlib.crc32(ids[a : a + room]) for a in range(head, len(ids), room))])
        columns = [batch.column("doc_id"), pa.array(first, pa.int32()), pa.array(crcs, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "first", "crcs"])

    rows = mapped(docs.select("doc_id", "text"), of_batch, "doc_id long, first int, crcs array<long>")
    return rows.withColumn("ordinal", F.monotonically_increasing_id())  # fixed once written


@dataclass
class Run:
    """`count` sequences that hold these lengths one after another."""

    count: int
    lengths: list[int]


def sizes_of_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [[length, count], ...] from long to short) per group; groups of one size are one."""
    total = sum(counts.values())
    out: list[tuple[int, list[list[int]]]] = []
    taken = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            border = -(-total * (taken * groups // total + 1) // groups)  # where this group ends
            part = min(left, border - taken)
            new = taken * groups // total != (taken - 1) * groups // total if taken else True
            if not out or new and out[-1][0] != length:
                out.append((length, [[length, part]]))
            elif out[-1][1][-1][0] == length:
                out[-1][1][-1][1] += part
            else:
                out[-1][1].append([length, part])
            taken += part
            left -= part
    return out


def knapsack(sizes: np.ndarray, price: np.ndarray, fits: np.ndarray) -> tuple[float, np.ndarray]:
    """The worthiest configuration: its worth, and how many of each size. fits[c]: ascending sizes up to c."""
    room = len(fits) - 1
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fits[c]:
            worth = best[c - sizes[: fits[c]]] + price[: fits[c]]
            j = worth.argmax()
            if worth[j] > best[c] + 1e-12:
                best[c], pick[c] = worth[j], j
    column = np.zeros(len(sizes))
    c = room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each ascending size) and how often each is used in the programme's optimum.

    Column generation. A column is priced near the best dual prices so far (first the share of the room that a
    size takes) and, if that gives none, nearer to the present ones. It ends at the optimum, within half a
    sequence and 0.02 % of the best bound, or after `most` columns with what it has then: any basis serves.
    """
    k = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    centre = sizes / room
    bound = centre @ demand
    for _ in range(most):
        if x.sum() <= bound * 1.0002 + 0.5:
            break
        now = np.maximum(inverse.sum(0), 0)
        for near in (0.8, 0.5, 0.2, 0.0):
            price = near * centre + (1 - near) * now
            worth, column = knapsack(sizes, price, fits)
            if price @ demand / max(worth, 1) > bound:
                bound, centre = price @ demand / max(worth, 1), price / max(worth, 1)
            if now @ column > 1 + 1e-7:
                break
        else:
            break
        along = inverse @ column
        ratio = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * along, 0)
        x[out] = step
        basis[:, out] = column
        row = inverse[out] / along[out]
        inverse = inverse - np.outer(along, row)
        inverse[out] = row
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


def plan(counts: dict[int, int], settings: Settings = Settings()) -> list[Run]:
    """Runs that place every length as often as it is counted."""
    room = settings.room
    large = {n: c for n, c in counts.items() if n > settings.small and c}
    runs: list[Run] = []
    rest: dict[int, int] = defaultdict(int, {n: c for n, c in counts.items() if n <= settings.small and c})
    if large:
        groups = sizes_of_groups(large, settings.groups)[::-1]  # ascending sizes
        queues = [list(reversed(q)) for _, q in groups]  # the longest last
        sizes = np.array([size for size, _ in groups])
        demand = np.array([float(sum(c for _, c in q)) for _, q in groups])
        for column, often in configurations(sizes, demand, room):
            left = int(often + 1e-6)
            kinds = [(g, int(column[g])) for g in np.flatnonzero(column)]
            while left:
                have = [min(sum(c for _, c in queues[g]) // n for g, n in kinds), left]
                if not min(have):
                    break
                now = min(*have, *(queues[g][-1][1] // n or 1 for g, n in kinds))
                lengths = []
                for g, n in kinds:
                    even = queues[g][-1][1] >= n
                    for _ in range(1 if even else n):
                        lengths += [queues[g][-1][0]] * (n if even else 1)
                        queues[g][-1][1] -= n * now if even else 1
                        if not queues[g][-1][1]:
                            queues[g].pop()
                runs.append(Run(now, lengths))
                left -= now
        for q in queues:
            for length, count in q:
                rest[length] += count
    by_room: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_room[room - sum(run.lengths)].append(run)
    open_rooms = sorted(by_room)
    for length in sorted(rest, reverse=True):
        need = rest[length]
        while need:
            spot = _at_least(open_rooms, length)
            if spot is None:
                many = min(need, room // length)
                new = Run(need // many, [length] * many)
                need -= new.count * many
            else:
                old = by_room[spot].pop()
                if not by_room[spot]:
                    open_rooms.remove(spot)
                now = min(need, old.count)
                if now < old.count:
                    _put(by_room, open_rooms, Run(old.count - now, old.lengths), spot)
                new = Run(now, [*old.lengths, length])
                need -= now
            _put(by_room, open_rooms, new, room - sum(new.lengths))
    return [run for at in sorted(by_room) for run in by_room[at]]


def _at_least(ordered: list[int], value: int) -> int | None:
    at = np.searchsorted(ordered, value)
    return ordered[at] if at < len(ordered) else None


def _put(by_room: dict[int, list[Run]], open_rooms: list[int], run: Run, spot: int) -> None:
    if not by_room[spot]:
        open_rooms.insert(int(np.searchsorted(open_rooms, spot)), spot)
    by_room[spot].append(run)


def places(runs: list[Run]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, lo, hi, sequence of lo, offset) per run and place in it, and the number of sequences."""
    used: dict[int, int] = defaultdict(int)
    out, sequences = [], 0
    for run in runs:
        offset = 0
        for length in run.lengths:
            out.append((length, used[length], used[length] + run.count, sequences, offset))
            used[length] += run.count
            offset += length
        sequences += run.count
    return out, sequences


def packed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A missing text is empty: one piece that holds the end id alone. Repeated rows and missing doc_ids are
    packed like any other. No documents: no rows.
    """
    spark = docs.sparkSession
    rows = keep(tokenised(docs, settings))
    counts = {r["first"]: r["n"] for r in rows.groupBy("first").agg(F.count("*").alias("n")).collect()}  # `room` rows at most
    total = sum(counts.values())
    spots, sequences = places(plan(counts, settings))
    before = np.cumsum([0, *(counts.get(n, 0) for n in range(settings.room))]).tolist()  # shorter first pieces, by length
    spots = [(*spot, before[spot[0]]) for spot in spots]
    table_ = spark.createDataFrame(spots, "first int, lo long, hi long, sequence long, offset long, earlier long")

    parts = max(1, -(-total // settings.rows))
    part = F.pmod(F.hash("ordinal"), F.lit(parts))
    dealt = rows.withColumn("part", part)
    sums = dealt.groupBy("first", "part").agg(F.count("*").alias("n"))
    below = Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows
    sums = sums.select("first", "part", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below"))
    inside = F.row_number().over(Window.partitionBy("first", "part").orderBy("ordinal")) - 1
    numbered = dealt.withColumn("inside", inside).join(sums, ["first", "part"]).withColumn("rank", F.col("below") + F.col("inside"))
    spot = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = numbered.join(F.broadcast(table_), "first").where(spot)  # the plan: bounded by `room`, not by the corpus
    row = (F.col("earlier") + F.col("rank")) * F.lit(1 << 22)
    pieces = placed.select("doc_id", "first", "sequence", "lo", "rank", "offset", row.alias("row"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    head = F.col("piece") == 0
    return pieces.select(
        "doc_id",
        "piece",
        F.when(head, 0).otherwise(F.col("first") + (F.col("piece") - 1) * settings.room).cast("long").alias("start"),
        F.when(head, F.col("first")).otherwise(settings.room).cast("long").alias("length"),
        "ids_crc32",
        F.when(head, F.col("sequence") + F.col("rank") - F.col("lo")).otherwise(F.lit(sequences) + F.col("row") + F.col("piece")).alias("sequence_id"),
        F.when(head, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens."""
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces of its documents."""
    return packed(docs.select("doc_id", "text"))
