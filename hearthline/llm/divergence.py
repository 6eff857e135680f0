"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are counted in the tasks, which give one row per source and term. A language keeps the terms that enough of
its documents hold. Smoothed shares p are whole billionths, and the divergence of one share from another,
floor((p - q)^2 / q), is a whole number, so nothing depends on the order of summation.

Leading terms, by a dominance skyband: a term's divergence from its language grows with its count in the group and
falls with its count in the language, as long as p > q; equal ones rank by UTF-8. So a term is ranked below each
term that has no smaller count in the group, no larger one in the language and comes earlier in UTF-8, whatever the
divisors. A partition keeps, per group, the terms that fewer than `top` others of it dominate; skybands are merged
in salted steps, each keeping the skyband of what it reads. What is left is ranked by its exact divergence.

Source pairs: blocks of terms hold all sources' counts of them. A block adds up the divergence of each source from
each other one over its terms. Terms that a source doesn't have share one p, so only counts that exist are looked
at: work is sources x counts. A block gives one row per pair; Spark sums them.

Definitions: missing text, lang and source are ''. A group without terms has p = 1 + floor(10^9 / V) for each kept
term. A language without kept terms gives each pair 0 and no terms. Repeated rows are documents of their own. One
source gives no pairs. No documents, no rows. Texts are whole; a very long one is counted alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.tables import keep, ship, steps, table


@dataclass(frozen=True)
class Settings:
    """`least`: documents of the language that hold a kept term. `top`: ranks of terms. `salts`: buckets per group of
    the steps in which skybands are merged. `block`: counts in a block of terms, about."""

    least: int = 3
    top: int = 200
    salts: tuple[int, ...] = (1024, 32, 1)
    block: int = 100_000


UNIT = 1_000_000_000
#: Counts from here on are multiplied by UNIT as decimals.
WIDE = 9_000_000_000
#: Counts that a task holds before it gives them out.
HELD = 400_000
#: Terms end where ASCII has no letter; A-Z are lowered.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _names(docs: DataFrame) -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term."""

    def given(held: dict) -> pa.RecordBatch:
        sized = [len(found) for found, _ in held.values()]
        lang, source = (pa.array([key[i] for key in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sized))) for i in (0, 1))
        term = pa.array([t for found, _ in held.values() for t in found], pa.binary()).cast(pa.string())
        n = pa.array([n for found, _ in held.values() for n in found.values()], pa.int64())
        docs = pa.array([n for found, docs in held.values() for n in map(docs.__getitem__, found)], pa.int64())
        return pa.RecordBatch.from_arrays([lang, source, term, n, docs], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in (step for whole in batches for step in steps(whole)):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found, docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = (text or b"").translate(_TERMS).split()
                found.update(words)
                docs.update(set(words))
            if sum(len(found) for found, _ in held.values()) > HELD:
                yield given(held)
                held = {}
        yield given(held)

    ship(docs.sparkSession)
    rows = docs.select(*_names(docs), "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, size: str) -> Column:
    """p of a count where kept terms occur `size` times and there are `terms` of them. Decimals, which take longer,
    only where a long can't hold the product."""
    wide = f"({UNIT} * (cast({count} as decimal(20,0)) + 1)) div (cast({size} as decimal(20,0)) + terms)"
    return F.expr(f"1 + if({count} < {WIDE}, ({UNIT}L * ({count} + 1)) div ({size} + terms), {wide})")


@dataclass(frozen=True)
class Counts:
    """cells: lang, source, term, n, lang_n, of kept terms. groups: lang, source, size (occurrences of kept terms),
    terms (kept ones), lang_size, cells (of the language)."""

    cells: DataFrame
    groups: DataFrame


def counts(docs: DataFrame, settings: Settings = Settings()) -> Counts:
    term = Window.partitionBy("lang", "term")  # a row per source
    found = counted(docs).withColumns({"lang_n": F.sum("n").over(term), "held": F.sum("docs").over(term), "least": F.min("source").over(term)})
    # A term's language count stands in each of its cells: the first of its sources speaks for it.
    found = found.where(F.col("held") >= settings.least).withColumn("first", F.col("source") == F.col("least"))
    found = keep(found.select("lang", "source", "term", "n", "lang_n", "first"))
    spoken = [F.sum(F.when(F.col("first"), x)).alias(name) for name, x in (("terms", F.lit(1)), ("lang_size", F.col("lang_n")))]
    by_group = keep(found.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("cells"), *spoken))
    by_lang = by_group.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("terms", "lang_size", "cells")))
    groups = docs.select(*_names(docs)).distinct()
    joined = groups.join(by_group.select("lang", "source", "size"), ["lang", "source"], "left").join(by_lang, "lang", "left")
    return Counts(found.drop("first"), keep(joined.na.fill(0)))


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, top: int) -> np.ndarray:
    """Indexes of the rows that fewer than `top` others dominate. term: rank in UTF-8 order.

    Rows come in an order in which those that dominate one stand before it. Only rows that stay are held against
    later ones: whoever is dominated by `top` rows is so by `top` that stay.
    """
    order = np.lexsort((term, lang_n, -n))
    new = (np.diff(n[order], prepend=-1) != 0) | (np.diff(lang_n[order], prepend=-1) != 0)
    place = np.arange(len(order))
    order = order[place - np.maximum.accumulate(np.where(new, place, 0)) < top]  # of equal counts, the first terms
    count, names = lang_n[order], term[order].astype(np.int32)
    stays = np.zeros(0, np.int64)
    for at in range(0, len(order), 256):
        c, t = count[at : at + 256, None], names[at : at + 256, None]
        above = ((count[stays] <= c) & (names[stays] < t)).sum(1)
        above += np.tril((c.T <= c) & (t.T < t), -1).sum(1)
        stays = np.concatenate([stays, at + np.flatnonzero(above < top)])
    return order[stays]


_BAND = ["lang", "source", "term", "n", "lang_n"]


def _banded(rows: pa.Table, top: int) -> pa.Table:
    """The skyband of each group of rows (_BAND columns)."""
    group = pc.binary_join_element_wise(pc.cast(pc.binary_length(rows.column("lang")), pa.string()), rows.column("lang"), rows.column("source"), " ")
    code = np.asarray(pc.rank(group, tiebreaker="dense"), np.int64)
    term = np.asarray(pc.rank(rows.column("term"), tiebreaker="dense"), np.int64)
    n, lang_n = (rows.column(c).to_numpy() for c in ("n", "lang_n"))
    by = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[by], prepend=0, append=0))
    stays = [by[a:b][skyband(n[by[a:b]], lang_n[by[a:b]], term[by[a:b]], top)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return rows.take(pa.array(np.concatenate(stays)))


def skybands(rows: DataFrame, top: int) -> DataFrame:
    """The skyband of each group among the rows of each partition, or of parts of it."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > HELD:
                left = _banded(pa.Table.from_batches(held).combine_chunks(), top)
                held = left.to_batches()
                if left.num_rows > HELD // 2:  # many groups, or wide skybands: a later step goes on
                    yield from held
                    held = []
        if sum(b.num_rows for b in held):
            yield from _banded(pa.Table.from_batches(held).combine_chunks(), top).to_batches()

    ship(rows.sparkSession)
    return rows.select(*_BAND).mapInArrow(run, "lang string, source string, term string, n long, lang_n long")


def leading_terms(found: Counts, settings: Settings = Settings()) -> DataFrame:
    """lang, source, item, value, rank: each group's terms with the largest divergence from the language."""
    sized = found.cells.join(found.groups, ["lang", "source"])
    band = skybands(sized.where(share("n", "size") > share("lang_n", "lang_size")), settings.top)
    for salts in settings.salts:
        band = skybands(band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(salts))), settings.top)
    shares = band.join(found.groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "size").alias("p"), share("lang_n", "lang_size").alias("q"))
    valued = shares.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return _ranked(valued).where(F.col("rank") <= settings.top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def divergences(source: np.ndarray, term: np.ndarray, p: np.ndarray, absent: np.ndarray, terms: int) -> np.ndarray:
    """Row a, column o: the divergence of source a from source o over a block's terms.

    source, term, p: the shares that occur, by source; absent: each source's p of a term that it doesn't have.
    """
    n = len(absent)
    sized = np.bincount(source, minlength=n)
    edges = np.concatenate(([0], np.cumsum(sized)))

    def f(p, q):
        return (p - q) * (p - q) // q

    def by_source(values):
        total = np.concatenate(([0], np.cumsum(values)))
        return total[edges[1:]] - total[edges[:-1]]

    out = np.zeros((n, n), np.int64)
    own = np.zeros(terms, np.int64)
    for a in range(n):
        mine = slice(edges[a], edges[a + 1])
        own[:] = 0
        own[term[mine]] = p[mine]
        there = own[term]
        both = there > 0
        value = f(np.where(both, there, absent[a]), p) - np.where(both, f(there, absent[source]), 0)
        share, times = np.unique(p[mine], return_counts=True)
        alone = (f(share[:, None], absent[None]) * times[:, None]).sum(0)
        neither = terms - sized[a] - sized + by_source(both)
        out[a] = by_source(value) + alone + neither * f(absent[a], absent)
    return out


def pair_divergences(found: Counts, settings: Settings = Settings()) -> DataFrame:
    """lang, source, item, value, rank: each group's divergence from each other source of its language."""
    groups = found.groups.select("lang", "source", "size", "terms", F.greatest(F.lit(1), F.ceil(F.col("cells") / settings.block)).cast("int").alias("blocks"))
    cells = found.cells.join(groups, ["lang", "source"])
    cells = cells.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", share("n", "size").alias("p"))
    # Where there are no kept terms, p is needed for none.
    absent = F.when(F.col("terms") > 0, share("0", "size")).otherwise(1).alias("p")
    sides = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), absent)

    def unit(rows: pa.Table) -> pa.Table:
        side = pc.is_null(rows.column("term"))
        heads, cells = rows.filter(side).sort_by("source"), rows.filter(pc.invert(side))
        names = heads.column("source").combine_chunks()
        source = np.asarray(pc.index_in(cells.column("source"), value_set=names), np.int64)
        coded = cells.column("term").combine_chunks().dictionary_encode()
        by = np.argsort(source, kind="stable")
        term, p = np.asarray(coded.indices, np.int64)[by], cells.column("p").to_numpy()[by]
        value = divergences(source[by], term, p, heads.column("p").to_numpy(), len(coded.dictionary))
        a, o = np.nonzero(~np.eye(len(names), dtype=bool))
        lang = pa.array([rows.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.table([lang, names.take(pa.array(a)), names.take(pa.array(o)), pa.array(value[a, o], pa.int64())], ["lang", "source", "item", "value"])

    ship(cells.sparkSession)
    parts = cells.unionByName(sides).groupBy("lang", "block").applyInArrow(unit, "lang string, source string, item string, value long")
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each (lang, source) group from the other sources of its lang (part `pair`), and its terms that
    differ most from its lang (part `term`). See the module's text for missing, empty and repeated rows."""
    found = counts(table(spark, sf_dir, "documents", "lang", "source", "text"))
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pair_divergences(found)), ("term", leading_terms(found)))]
    return parts[0].unionByName(parts[1])


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM places SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang
), sizes AS (
  SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN cells USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (s.size + g.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (g.size + g.v) AS q
  FROM sizes s JOIN kept k ON s.lang = k.lang JOIN langs g ON s.lang = g.lang
  LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), results AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM results
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
