"""Benchmark decontamination with suffix arrays of the training texts.

Texts are sharded: a shard is a few megabytes of one partition's documents. A task sorts the suffixes of its
shard's words and looks every test suffix up by binary search, one word deeper at a time: the stretch of the
suffix array that shares the words so far shrinks until it is empty. The stretch at the window's length holds
every place of that window, the last one that isn't empty the longest verbatim matches and their places.

Documents stay where they are read; only test words travel. They go to the tasks in blocks of at most
`block_bytes` of text; each block is one pass over the documents.

Words are compared by 64-bit hashes. Test suffixes that are too short to hold a window are not looked up, for
they match nothing: a window is `window` consecutive words of an item, or all words of an item that has fewer.

Definitions: a missing or empty text has no words and is never hit; an item without words has no window. Items
with one item_id are one item; those without an item_id are together the item ''. Repeated documents get a row
each. Other columns are not read. No documents, no rows; no items, no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import hashing
from hearthline.llm.tables import keep, ship, steps, table, texts


@dataclass(frozen=True)
class Settings:
    """`window`: words; `shard_bytes`: text in a suffix array, about; `block_bytes`: test text that a task holds, about."""

    window: int = 10
    shard_bytes: int = 4 << 20
    block_bytes: int = 16 << 20


@dataclass(frozen=True)
class Block:
    """Words of some items, one after another. Per word, as the start of a suffix: where its item ends, how many words a
    match needs (0: not looked up), its item's place in `names`, its number in its text."""

    words: np.ndarray
    stop: np.ndarray
    least: np.ndarray
    item: np.ndarray
    at: np.ndarray
    names: list[str]


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0] - 1, low[1] .. high[1] - 1 and so on."""
    size = high - low
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())


def block_of(ids: list, raw: list[bytes], window: int) -> Block:
    words, _, index = hashing.words(*hashing.joined(raw), ends=hashing.MARKS)
    size = np.diff(index)
    names = sorted({"" if i is None else str(i) for i in ids})
    number = {name: k for k, name in enumerate(names)}
    own = np.array([number["" if i is None else str(i)] for i in ids], np.int64)
    stop, at = np.repeat(index[1:], size), np.arange(len(words)) - np.repeat(index[:-1], size)
    left = stop - np.arange(len(words))
    least = np.where(left >= window, window, np.where(at == 0, left, 0))
    return Block(words, stop, least, np.repeat(own, size), at, names)


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of a sequence in the order of the suffixes that start there, by prefix doubling.

    Each text must end with a number that stands nowhere else. Only suffixes that still tie are sorted on, by
    the ranks of what follows.
    """
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s), np.int64)
    fresh = np.concatenate(([True], s[order[1:]] != s[order[:-1]]))[: len(s)]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    alone = fresh & np.concatenate((fresh[1:], [True]))[: len(s)]
    slots = np.flatnonzero(~alone)  # where tied suffixes stand in the order
    step = 1
    while len(slots):
        tied = order[slots]
        key = rank[tied] * len(s) + rank[tied + step]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[slots] = tied
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[tied] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
        step *= 2
    return order


class Shard:
    """The suffix array of some texts. Texts end with numbers of their own, below all words' numbers."""

    def __init__(self, raw: list[bytes]):
        words, _, index = hashing.words(*hashing.joined(raw), ends=hashing.MARKS)
        self.size = np.diff(index)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        texts = np.arange(len(raw))
        self.s = np.empty(len(words) + len(raw), np.int64)
        self.ends = index[1:] + texts
        self.s[np.arange(len(words)) + np.repeat(texts, self.size)] = number + len(raw)
        self.s[self.ends] = texts
        self.order = suffix_order(self.s)
        count = np.bincount(number, minlength=len(self.vocabulary))
        self.first = len(raw) + np.concatenate(([0], np.cumsum(count)))

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and number of the word for places in the sequence."""
        text = np.searchsorted(self.ends, at)
        return text, at - (self.ends[text] - self.size[text])

    def bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """In each stretch the first suffix whose word at `depth` is not below `word` (after: is above it)."""
        low, high = low.copy(), high.copy()
        while len(on := np.flatnonzero(low < high)):
            middle = (low[on] + high[on]) // 2
            found = self.s[self.order[middle] + depth]
            below = found <= word[on] if after else found < word[on]
            low[on] = np.where(below, middle + 1, low[on])
            high[on] = np.where(below, high[on], middle)
        return low

    def search(self, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth, the test suffixes that match so many words here, and the stretches where they do."""
        known = np.searchsorted(self.vocabulary, block.words)
        if not len(self.vocabulary) or not len(known):
            return
        here = self.vocabulary[np.minimum(known, len(self.vocabulary) - 1)] == block.words
        word = np.where(here, known + len(self.size), -1)
        missing = np.concatenate(([0], np.cumsum(~here)))
        start = np.arange(len(word))
        live = np.flatnonzero((block.least > 0) & (missing[start + block.least] == missing[start]))
        low, high = self.first[known[live]], self.first[known[live] + 1]
        depth = 1
        while len(live):
            yield depth, live, low, high
            on = live + depth < block.stop[live]
            live, low, high = live[on], low[on], high[on]
            wanted = word[live + depth]
            low = self.bound(low, high, depth, wanted, False)
            high = self.bound(low, high, depth, wanted, True)
            on = low < high
            live, low, high = live[on], low[on], high[on]
            depth += 1


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """values as one list per owner 0..n-1; owner ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def audited_step(raw: list[bytes], block: Block) -> list[pa.Array]:
    """n_words, spans, items, longest per text."""
    shard, n = Shard(raw), len(raw)
    best = np.zeros(len(shard.s), np.int64)  # longest match, by place in the suffix array
    edge = np.zeros(len(shard.s) + 1, np.int64)
    holders: dict[tuple[int, int], set[int]] = {}  # items by window
    for depth, live, low, high in shard.search(block):
        stretches = np.unique(np.stack([low, high], 1)[depth >= block.least[live]], axis=0)
        best[spread(stretches[:, 0], stretches[:, 1])] = depth
        whole = depth == block.least[live]
        for a, b, item in zip(low[whole].tolist(), high[whole].tolist(), block.item[live[whole]].tolist(), strict=True):
            holders.setdefault((a, b), set()).add(item)
        starts = np.unique(np.stack([low, high], 1)[whole], axis=0)
        at = shard.order[spread(starts[:, 0], starts[:, 1])]
        edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + depth, minlength=len(edge))
    hit = np.flatnonzero(best)
    text, _ = shard.place(shard.order[hit])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, best[hit])

    inside = np.cumsum(edge[:-1]) > 0
    change = np.diff(inside.astype(np.int8), prepend=np.int8(0))  # each text ends with a number that is never hit
    owner, first = shard.place(np.flatnonzero(change == 1))
    last = shard.place(np.flatnonzero(change == -1) - 1)[1]
    spans = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["first", "last"])

    sets: dict[frozenset[int], int] = {}  # windows of the same items count once in a text
    owned = [np.zeros(0, np.int64)]
    for (a, b), items in holders.items():
        number = sets.setdefault(frozenset(items), len(sets))
        owned.append(np.unique(shard.place(shard.order[a:b])[0]) * (1 << 32) + number)
    pairs, members, named = np.unique(np.concatenate(owned)), list(sets), {}
    for t, number in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
        named.setdefault(t, set()).update(members[number])
    items = pa.array([[block.names[k] for k in sorted(named.get(t, ()))] for t in range(n)], pa.list_(pa.string()))
    return [pa.array(shard.size, pa.int64()), _lists(owner, n, spans), items, pa.array(longest, pa.int64())]


def blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Block]:
    """The items' words in blocks whose texts have about `block_bytes` bytes."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-held // settings.block_bytes))
    for k in range(count):
        own = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        found = own.collect()
        yield block_of([r["item_id"] for r in found], [r["text"].encode() for r in found], settings.window)


def _sharded(docs: DataFrame, block: Block, settings: Settings, work, schema: str) -> DataFrame:
    """mapInArrow of work(rows, block) over the shards."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            for rows in steps(batch, most=settings.shard_bytes):
                yield work(rows, sent.value)

    return docs.mapInArrow(run, schema)


_AUDITED = "doc_id long, text_key binary, n_words long, spans array<struct<first:long,last:long>>, items array<string>, longest long"


def audited(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_key, n_words, spans, items, longest per row of docs.

    spans: words first..last (from 0) that windows cover, of one block of items each; items: the item_ids, as
    strings, whose windows occur; longest: words of the longest verbatim match that holds a window.
    """
    rows = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))

    def work(step: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        found = audited_step([x.encode() for x in texts(step)], block)
        return pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("text_key"), *found], ["doc_id", "text_key", "n_words", "spans", "items", "longest"])

    passes = [_sharded(rows, block, settings, work, _AUDITED) for block in blocks(benchmark, settings)]
    if len(passes) == 1:
        return passes[0]
    kept = [keep(p) for p in passes]
    hits = kept[0].where(F.size("items") > 0).select("text_key", "spans", "items", "longest")
    for more in kept[1:]:
        hits = hits.unionByName(more.where(F.size("items") > 0).select("text_key", "spans", "items", "longest"))
    merged = hits.distinct().groupBy("text_key").agg(  # a row for each block at most
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max("longest").alias("longest"),
    )
    none = [F.coalesce(c, F.expr(f"cast({empty} as {kind})")).alias(c) for c, empty, kind in (("spans", "array()", "array<struct<first:long,last:long>>"), ("items", "array()", "array<string>"), ("longest", "0", "long"))]
    return kept[0].select("doc_id", "text_key", "n_words").join(merged, "text_key", "left").select("doc_id", "text_key", "n_words", *none)


def longest_matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """item_id, item_word, n_words, doc_id, doc_word: the longest verbatim matches of items, and where they start.

    Of each place of an item the longest match with any document, if it holds a window and isn't the rest of the
    match of the place before; of several documents the least doc_id, of several places in it the first.
    """
    schema = "item_id string, item_word long, n_words long, doc_id long, doc_word long"

    def work(step: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        step = step.sort_by("doc_id")
        shard = Shard([x.encode() for x in texts(step)])
        length, low, high = (np.zeros(len(block.words), np.int64) for _ in range(3))
        for depth, live, a, b in shard.search(block):
            length[live], low[live], high[live] = depth, a, b
        found = np.flatnonzero((length >= block.least) & (block.least > 0))
        place = np.array([shard.order[a:b].min() for a, b in zip(low[found].tolist(), high[found].tolist(), strict=True)], np.int64)
        text, word = shard.place(place)
        columns = [
            pa.array([block.names[k] for k in block.item[found].tolist()], pa.string()),
            pa.array(block.at[found], pa.int64()),
            pa.array(length[found], pa.int64()),
            step.column("doc_id").take(pa.array(text)),
            pa.array(word, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["item_id", "item_word", "n_words", "doc_id", "doc_word"])

    rows = docs.select("doc_id", "text")
    parts = [_sharded(rows, block, settings, work, schema) for block in blocks(benchmark, settings)]
    every = parts[0] if len(parts) == 1 else keep(parts[0])
    for p in parts[1:]:
        every = every.unionByName(keep(p))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "doc_word")
    best = every.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("less"), place.alias("place"))).alias("best"))
    best = best.select("item_id", "item_word", (-F.col("best.less")).alias("n_words"), "best.place.doc_id", "best.place.doc_word")
    before = best.select("item_id", (F.col("item_word") + 1).alias("item_word"), (F.col("n_words") - 1).alias("rest"))
    return best.join(before, ["item_id", "item_word"], "left").where("rest IS NULL OR n_words > rest").drop("rest")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns, in which no window occurs."""

    def work(step: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        longest = audited_step([x.encode() for x in texts(step)], block)[-1]
        return step.filter(pa.array(np.asarray(longest) == 0))

    for k, block in enumerate(blocks(benchmark, settings)):
        docs = _sharded(docs if k == 0 else keep(docs), block, settings, work, docs.schema)
    return docs


def op13_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words in benchmark windows. See the module's text for missing and repeated rows."""
    found = audited(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    covered = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(done["end"], s["first"] - 1))).alias("n"),
            F.greatest(done["end"], s["last"]).alias("end"),
        ),
        lambda done: done["n"],
    )
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "longest",
    )


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT row_number() OVER () AS b, coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT b, item, j, n, array_to_string(w[j:j+n-1], ' ') AS g
  FROM (SELECT b, item, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS j FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), words AS (
  SELECT r, unnest(generate_series(1, len(w))) AS k, len(w) AS size, unnest(w) AS x FROM docs
), following AS (
  SELECT r, k, size, [x, """ + ", ".join(f"lead(x, {i}) OVER o" for i in range(1, 10)) + r"""] AS l FROM words WINDOW o AS (PARTITION BY r ORDER BY k)
), places AS (
  SELECT r, k, n, array_to_string(l[1:n], ' ') AS g FROM following, sizes WHERE k + n - 1 <= size
), hits AS (
  SELECT r, k, n, b, item, j FROM places JOIN windows USING (n, g)
), covered AS (
  SELECT r, count(DISTINCT k + i) AS n_hit
  FROM (SELECT r, k, unnest(generate_series(0, n - 1)) AS i FROM (SELECT DISTINCT r, k, n FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
), runs AS (
  SELECT r, n, b, k - j AS shift, k - row_number() OVER (PARTITION BY r, n, b, k - j ORDER BY k) AS run FROM hits
), longest AS (
  SELECT r, max(length) AS longest FROM (SELECT r, count(*) + n - 1 AS length FROM runs GROUP BY r, n, b, shift, run) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)
"""
