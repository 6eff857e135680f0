"""Near duplicates by a MinHash LSH forest, confirmed on whole shingle sets.

A text's set holds its distinct word shingles (64-bit hashes; A-Z lowered). Texts with equal sets are one
vertex. Each of `trees` orders reads the MinHash values from another place; vertices that share an order's
first `depth` values are a region.

Candidates come in three rounds, each confirmed on the whole sets, and each only between vertices that
aren't connected yet:
1. each vertex with the most central vertex of its regions (the one that meets the most others),
2. neighbours in sorted order, whose common prefix is the longest, and the regions' other centres; a region
   with more than `crowd` vertices is parted by `depth` more values first,
3. in the regions of one centre together, if more than one component is left: whatever isn't in the largest
   one with all others that share one of its rarest shingles, exactly and without a limit. Large groups are taken
   apart by shingle.
So a pair is only missed if it shares no region, with probability (1 - s^depth)^trees at similarity s, 3e-6 at 0.8, or
if its signatures agree far less often than its sets (six standard deviations, 6e-8 at 0.85).

Definitions: a missing text or one without words has an empty set and is linked with nothing. Fewer words
than a shingle make one shingle. Repeated rows are equal texts. A missing doc_id is never the least one of its
component unless all are missing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm import hashing
from hearthline.llm.components import components
from hearthline.llm.tables import keep, mapped, ship, table, texts

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """`percent`: least similarity. `crowd`: vertices that one sorted stretch may hold. `block`: shingles that one task compares."""

    shingle: int = 5
    percent: int = 80
    trees: int = 24
    depth: int = 4
    crowd: int = 64
    neighbours: int = 2
    block: int = 1_000_000

    @property
    def slots(self) -> int:
        return self.trees * self.depth


def signature(found: np.ndarray, slots: int) -> np.ndarray:
    """The least of each slot's 32-bit hash of the shingles."""
    a, b = hashing.stream(41, slots) | U64(1), hashing.stream(42, slots)
    best = np.full(slots, 0xFFFFFFFF, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            best = np.minimum(best, ((found[at : at + 2048, None] * a + b) >> U64(32)).min(0))
    return best.astype("<u4")


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (NULL: empty set), signature per row of docs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = hashing.shingle_sets([x.encode() for x in texts(batch)], settings.shingle)
        columns = [
            batch.column("doc_id"),
            batch.column("text_hash"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            pa.array([signature(s, settings.slots).tobytes() if len(s) else None for s in sets], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_id", "signature"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return mapped(rows, work, "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary")


def forest(vertices: DataFrame, settings: Settings) -> DataFrame:
    """(region, rest, id): for each order, a hash of its first values, and the next four, 16 bits of each, to sort by."""
    trees, depth, slots = settings.trees, settings.depth, settings.slots
    weight = hashing.stream(43, depth) | U64(1)
    seed = hashing.stream(44, trees)
    after = (np.arange(trees)[:, None] * depth + depth + np.arange(4)) % slots

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("id")
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, slots)
        with np.errstate(over="ignore"):
            first = values.reshape(-1, trees, depth).astype(U64)
            region = hashing.mix((hashing.mix(first) * weight).sum(2, dtype=U64) + seed).ravel().view(np.int64)
            rest = np.zeros((len(values), trees), U64)
            for k in range(4):
                rest = rest << U64(16) | (values[:, after[:, k]] >> np.uint32(16)).astype(U64)
        each = pa.array(np.repeat(np.arange(len(ids)), trees))
        return pa.RecordBatch.from_arrays([pa.array(region), pa.array(rest.ravel().view(np.int64)), ids.take(each)], ["region", "rest", "id"])

    return mapped(vertices.select("id", "signature"), work, "region long, rest long, id binary", "signature")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    pair = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return pair.where(F.col("a") < F.col("b")).distinct()


def confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose whole sets are similar enough.

    Pairs whose signatures agree far less often than such sets' would (six standard deviations) are left out
    before the sets travel.
    """
    slots, percent = settings.slots, settings.percent
    s = percent / 100
    least = slots * s - 6 * (slots * s * (1 - s)) ** 0.5

    def both(rows: DataFrame, what: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            rows = rows.join(what.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return rows

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, other = (np.frombuffer(b"".join(batch.column(f"signature_{x}").to_pylist()), "<u4").reshape(-1, slots) for x in "ab")
        return batch.select(["a", "b"]).filter(pa.array((one == other).sum(1) >= least))

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
            one, other = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            common = len(np.intersect1d(one, other, assume_unique=True))
            good.append(100 * common >= percent * (len(one) + len(other) - common))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    near = mapped(both(pairs, signatures, "signature"), alike, "a binary, b binary", "signature_a")
    return mapped(both(near, sets, "shingles"), similar, "a binary, b binary", "shingles_a")


def whole_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(id, shingles) of the wanted vertices (id, doc_id, text_hash), made again from one text of each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = hashing.shingle_sets([x.encode() for x in texts(batch)], settings.shingle)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    found = rows.join(wanted.alias("w"), same).select("w.id", "d.text")
    return mapped(found, work, "id binary, shingles binary").dropDuplicates(["id"])


def closed(hubs: DataFrame, sets: DataFrame, signatures: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between components that are left within the groups (hub, id).

    In a group all vertices outside its largest component are held against all its vertices: exactly, but only
    where they share one of the outer vertex's rarest shingles. A set that is similar enough lacks so few of them
    that it holds one of any `spare` of them, the rarest ones too. A group of up to `block` shingles is one unit of
    work; a larger one is taken apart by shingle (see rare_pairs).
    """
    sized = sets.select("id", (F.octet_length("shingles") / 8).alias("n"))
    group = hubs.join(sized, "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    group = keep(group.select("hub", "id", "n", "label"))
    parts = group.groupBy("hub", "label").agg(F.count("*").alias("vertices"), F.sum("n").alias("held"))
    open_ = parts.groupBy("hub").agg(
        F.max(F.struct("vertices", "label")).alias("main"), F.count("*").alias("parts"), F.sum("vertices").alias("vertices"), F.sum("held").alias("held")
    )
    open_ = open_.where((F.col("parts") > 1) & (F.col("vertices") > settings.neighbours + 1))
    left = group.join(open_.select("hub", F.col("main.label").alias("main"), (F.col("held") > settings.block).alias("large")), "hub")
    left = left.select("hub", "id", "label", (F.col("label") != F.col("main")).alias("outer"), "large").join(sets, "id")
    small = _small_groups(left.where(~F.col("large")).drop("large"), settings)
    large = rare_pairs(left.where("large").drop("large"), settings)
    return small.unionByName(confirmed(large, signatures, sets, settings))


def spare(size, percent: int):
    """Of so many shingles of a set, each set that is similar enough holds one: it lacks fewer than these."""
    return size - (-(-percent * size // 100)) + 1


def _small_groups(rows: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) within groups that a task can hold; rows: hub, id, label, outer, shingles."""
    percent = settings.percent

    def unit(found: pa.Table) -> pa.Table:
        ids, names, outer = (found.column(c).to_pylist() for c in ("id", "label", "outer"))
        arrays = [np.frombuffer(x, "<u8") for x in found.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in arrays])
        owner = np.repeat(np.arange(len(arrays)), sizes)
        values = np.concatenate(arrays)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]

        def owners(low, high):
            length = high - low
            return owner[np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())]

        a, b = [], []
        for i in (k for k, is_outer in enumerate(outer) if is_outer):
            one = arrays[i]
            low, high = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
            rare = np.argsort(high - low, kind="stable")[: spare(len(one), percent)]
            near = np.unique(owners(low[rare], high[rare]))
            near = near[near != i]
            if len(near) > 64:
                common = np.bincount(owners(low, high), minlength=len(arrays))[near]
            else:
                common = np.array([len(np.intersect1d(one, arrays[k], assume_unique=True)) for k in near.tolist()], np.int64)
            seen = {names[i]}
            for k in near[100 * common >= percent * (len(one) + sizes[near] - common)].tolist():
                if names[k] not in seen:  # one link to each component is enough
                    seen.add(names[k])
                    a.append(ids[i])
                    b.append(ids[k])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    ship(rows.sparkSession)
    return rows.groupBy("hub").applyInArrow(unit, "a binary, b binary")


def rare_pairs(rows: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of different components that share one of an outer vertex's `spare` rarest shingles of its group.

    rows: hub, id, label, outer, shingles. Shingles are counted per group, each with the least and the greatest
    component that has it. A shingle of a single vertex, or of a single component, brings no pair, but takes its
    place among the rarest. So a template that many unlike pages share costs one count per shingle and page: pages
    have enough shingles of their own to fill those places.
    """

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("shingles").to_pylist()
        size = np.array([len(x) // 8 for x in raw], np.int64)
        each = pa.array(np.repeat(np.arange(len(raw)), size))
        token = np.frombuffer(b"".join(raw), "<u8").view(np.int64)
        columns = [batch.column(c).take(each) for c in ("hub", "id", "label", "outer")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(size, size)), pa.array(token)], ["hub", "id", "label", "outer", "size", "token"])

    schema = "hub binary, id binary, label binary, outer boolean, size long, token long"
    tokens = mapped(rows.select("hub", "id", "label", "outer", "shingles"), opened, schema, "shingles")
    counts = tokens.groupBy("hub", "token").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("n > 1")
    shared = tokens.where("outer").join(counts, ["hub", "token"])
    own = Window.partitionBy("hub", "id")
    placed = shared.withColumns({"place": F.row_number().over(own.orderBy("n", "token")), "shared": F.count("*").over(own)})
    room = F.expr(f"size - ceil({settings.percent} * size / 100) + 1 - (size - shared)")
    rare = placed.where((F.col("place") <= room) & (F.col("least") != F.col("most"))).select("hub", "token", F.col("id").alias("one"), F.col("label").alias("of"))
    met = rare.join(tokens.select("hub", "token", "id", "label"), ["hub", "token"]).where(F.col("of") != F.col("label"))
    return _pairs(met.select("one", "id").distinct(), "one", "id")


def linked(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id, component per row of docs; component: a set_id that all rows
    of a component share, NULL for empty sets."""
    rows = keep(signed(docs, settings))
    named = rows.where(F.col("set_id").isNotNull()).groupBy(F.col("set_id").alias("id"))
    vertices = keep(named.agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one"), F.first("signature").alias("signature")))
    orders = forest(vertices, settings)
    sizes = orders.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    members = keep(orders.join(sizes, "region"))
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = keep(members.join(weights, "id"))
    centre = members.groupBy("region").agg(F.max(F.struct("weight", "id")).alias("top"))
    centres = members.join(centre, "region").select("id", "top")
    wanted = vertices.join(weights, "id", "left_semi").select("id", "one.*")
    sets = keep(whole_sets(docs, wanted, settings))
    signatures = vertices.select("id", "signature")

    labels = None  # (id, label) of vertices that have links

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of vertices in different components so far."""
        if labels is None:
            return pairs
        for side in "ab":
            pairs = pairs.join(labels.select(F.col("id").alias(side), F.col("label").alias(f"of_{side}")), side, "left")
        return pairs.where(~F.coalesce("of_a", "a").eqNullSafe(F.coalesce("of_b", "b"))).select("a", "b")

    def joined(links: DataFrame) -> DataFrame:
        """The labels after new links: components of the labels, carried over to their vertices."""
        links = keep(links)
        if labels is None:
            return keep(components(links))
        if links.isEmpty():
            return labels
        ends = links
        for side in "ab":
            ends = ends.join(labels.select(F.col("id").alias(side), F.col("label").alias(f"of_{side}")), side, "left")
        merged = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
        merged = merged.select(F.col("id").alias("label"), F.col("label").alias("new"))
        carried = labels.join(merged, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
        fresh = merged.join(labels, merged["label"] == labels["id"], "left_anti")
        return keep(carried.unionByName(fresh.select(F.col("label").alias("id"), F.col("new").alias("label"))))

    best = centres.groupBy("id").agg(F.max("top").alias("top"))
    first = keep(_pairs(best.select("id", F.col("top.id").alias("other")), "id", "other"))
    labels = joined(confirmed(first, signatures, sets, settings))

    deeper = members.where(F.col("n") > settings.crowd)
    parts = deeper.groupBy("region", "rest").agg(F.count("*").alias("m")).where(F.col("m").between(2, settings.crowd))
    shallow = members.where(F.col("n") <= settings.crowd).select("region", F.lit(0).cast("long").alias("part"), "rest", "id")
    stretches = shallow.unionByName(deeper.join(parts, ["region", "rest"]).select("region", F.col("rest").alias("part"), "rest", "id"))
    order = Window.partitionBy("region", "part").orderBy("rest", "id")  # `crowd` rows at most
    beside = F.array(*[F.lag("id", k).over(order) for k in range(1, settings.neighbours + 1)])
    near = stretches.select("id", beside.alias("others")).select("id", F.explode("others").alias("other")).where("other IS NOT NULL")
    second = _pairs(near.unionByName(centres.select("id", F.col("top.id").alias("other"))), "id", "other")
    second = keep(apart(second.join(first, ["a", "b"], "left_anti")))
    labels = joined(confirmed(second, signatures, sets, settings))

    hubs = centres.select(F.col("top.id").alias("hub"), "id").distinct()
    labels = joined(closed(hubs, sets, signatures, labels, settings))

    component = rows.join(labels.select(F.col("id").alias("set_id"), "label"), "set_id", "left")
    return component.select("doc_id", "text_hash", "n_shingles", "set_id", F.coalesce("label", "set_id").alias("component"))


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs (doc_id, text)."""
    rows = linked(docs, settings)
    least = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least"))
    named = rows.join(least, "component", "left")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class: three-word shingles, similarity 0.85."""
    return classes(table(spark, sf_dir, "documents", "doc_id", "text"), Settings(shingle=3, percent=85))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """One row of each component of docs, all columns: the one with the least doc_id (then the least text hash).

    Of repeated rows one stays. Rows without words stay.
    """
    rows = linked(docs.select("doc_id", "text"), settings)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    chosen = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(key).alias("one"))
    chosen = chosen.select("one.doc_id", "one.text_hash").alias("c")
    hashed = "text_hash" + "_" * max(map(len, docs.columns))  # longer than any name of docs
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.where(worded).withColumn(hashed, F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col(f"d.{hashed}") == F.col("c.text_hash"))
    kept = marked.join(chosen, same, "left_semi").dropDuplicates(["doc_id", hashed]).drop(hashed)
    return kept.unionByName(docs.where(~worded))
