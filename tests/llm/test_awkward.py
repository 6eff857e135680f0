"""Every query and stage over awkward tables, and over empty ones."""

import corpora
import pytest

import corpus_pipeline
from hearthline.llm import licenses, line_rules, multiset, near_dedup, packing, pieces, quality_mil, sharding, toxicity
from hearthline.llm.queries import ORACLES, QUERIES

N = len(corpora.AWKWARD)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"shard_directory", "op3_packing", "op6_fixity", "op11_divergence", "op12_centroids"}))
def test_a_row_for_each_awkward_document(spark, awkward, name):
    rows = QUERIES[name](spark, awkward).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(x[0]) for x in corpora.AWKWARD)


@pytest.mark.parametrize("name", ["op2_quality", "op10_toxicity"])
def test_scores_of_awkward_texts(spark, awkward, name):
    rows = QUERIES[name](spark, awkward).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all((r["held_out"] is None) == (r["doc_id"] is None) for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(empty) == 1


def test_packing_of_awkward_texts(spark, awkward):
    rows = packing.op3_packing(spark, awkward).collect()
    assert sum(r["piece"] == 0 for r in rows) == N
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in ends.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1]


def test_rules_of_awkward_texts(spark, awkward):
    rows = {(r["doc_id"], r["n_words"]): r for r in line_rules.op5_line_rules(spark, awkward).collect()}
    for doc_id in (1, 2, 3):
        r = rows[doc_id, 0]
        assert (r["word_chars"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (0, 0, 0, True, False)
    assert rows[11, 700]["n_dup_lines"] == 49 and rows[11, 700]["n_repeat_words"] == 700
    assert rows[10, 1]["word_chars"] == 60_000
    assert rows[8, 30_000]["kept"] and rows[8, 30_000]["n_repeat_words"] == 0


def test_classes_of_awkward_texts(spark, awkward):
    rows = near_dedup.op7_near_dedup(spark, awkward).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert found[1] == {(0, 1, True)} and found[2] == {(0, 2, True)} and found[3] == {(0, 3, True)}
    assert found[4] == found[4] and found[5] == {(1, 4, False)}
    assert (12, 6, False) in found[7] and found[6] == {(12, 6, True)}
    assert found[9] == {(29_999, 8, False)}
    assert (0, None, True) in found[None]


def test_pieces_are_whole_in_general_output(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for r, text in zip(pieces.encoded(docs).collect(), [x[1] for x in corpora.AWKWARD], strict=True):
        assert r["decoded"] == (text or "").replace("▁", " ")


def test_licenses_of_awkward_texts(spark, awkward):
    rows = licenses.op8_licenses(spark, awkward).collect()
    base = [r for r in rows if r["n_base"]]
    assert len(base) == 1 and (base[0]["base_labels"], base[0]["first_word"], base[0]["last_word"], base[0]["score"]) == ("mit", 7, 7, 1.0)
    assert all(r["labels"] == "" and r["first_word"] is None and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))


STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_return_whole_rows_and_all_columns(spark, awkward, nothing, name):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    out = STAGES[name](spark, docs, awkward)
    assert out.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    assert {tuple(r) for r in out.collect()} <= set(rows)
    assert STAGES[name](spark, spark.read.parquet(f"{nothing}/documents.parquet"), nothing).collect() == []


def test_near_duplicate_stage_keeps_one_of_each(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = STAGES["near duplicates"](spark, docs, awkward).select("doc_id", "text").collect()
    assert sum(r["text"] == corpora.LINE for r in kept) == 1
    assert sum((r["text"] or "").startswith("word0 ") for r in kept) == 1
    assert {r["doc_id"] for r in kept} >= {1, 2, 3}  # without words: linked with nothing


def test_no_oracle_without_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_shards_replace_columns_of_their_names(spark, awkward):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    out = sharding.sharded(docs, ["doc_id", "text"], F.octet_length("text"), 1000)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == N


def test_multiset_of_one_document_is_its_own_next(spark, tmp_path):
    row = multiset.op4_multiset(spark, corpora.write(tmp_path, [(1, "abcdefgh", "s")])).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 8


def test_scores_without_labels(spark, tmp_path):
    sf = corpora.write(tmp_path, corpora.AWKWARD)
    assert all(r["predicted"] == 0 for r in toxicity.op10_toxicity(spark, sf).collect())
    assert all(r["predicted"] == 1 for r in quality_mil.op2_quality(spark, sf).collect())
