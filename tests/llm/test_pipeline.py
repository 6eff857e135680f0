"""The pipeline's rows against its stages by hand."""

import zlib

import corpora
import numpy as np
from test_near_dedup import brute
from test_tokens import plain_ids

import corpus_pipeline
from hearthline.llm import line_rules, toxicity


def test_pipeline_packs_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{corpora.SMALL}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.op10_toxicity(spark, corpora.SMALL).collect()}
    calm = docs.where(docs.doc_id.isin([i for i, p in scores.items() if not p]))
    good = {r["doc_id"] for r in line_rules.verdicts(calm).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in calm.where(docs.doc_id.isin(list(good))).collect()}
    assert 0 < len(good) < calm.count() < docs.count()
    classes = brute(sorted(texts.items()), 5, 80)
    one_each = sorted(i for i, (_, component) in classes.items() if i == component)
    rows = corpus_pipeline.run(spark, corpora.SMALL).toPandas()
    assert sorted(set(rows.doc_id)) == one_each and len(one_each) < len(good)
    for i, found in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array([*plain_ids(texts[i]), 2], "<u4")
        assert [zlib.crc32(ids[a : a + n]) for a, n in zip(found.start, found.length, strict=True)] == found.ids_crc32.tolist()
