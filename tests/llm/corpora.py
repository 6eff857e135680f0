"""Small tables for the corpus operators, awkward ones among them."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
EMBEDDINGS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])

LINE = "the quick brown fox jumps over the lazy dog near the old river bank"
LONG = " ".join(f"word{i}" for i in range(30_000))
RUN = "a" * 60_000
#: doc_id, text, source
AWKWARD = [
    (None, "a text without an id that is long enough to have some words in it", "s1"),
    (None, None, None),
    (1, None, "s1"),
    (2, "", "s1"),
    (3, " \t\n\x0b\r ", "s1"),
    (4, "one", "s1"),
    (5, "One", "s1"),
    (6, LINE, "s1"),
    (7, LINE, "s2"),
    (7, LINE, "s2"),
    (7, "another text under the same id, licensed under the MIT License", None),
    (8, LONG, "s1"),
    (9, LONG + " tail", "s2"),
    (10, RUN, "s1"),
    (11, "\n".join([LINE] * 50), "s1"),
    (12, "naïve café 😀   日本語 ﬁ\x00 <|endoftext|> <s> ▁x", "s1"),
    (-5, "negative id " * 30, "s1"),
    (2**62, "a very large id", "s1"),
]
_NAN, _INF = float("nan"), float("inf")
#: vec_id, embedding, label; kept are those with 64 numbers
VECTORS = [
    *[(i, [((i * 37 + k * 11) % 23 - 11) / 7 for k in range(64)], i % 3) for i in range(40)],
    *[(40 + i, [0.5] * 64, None) for i in range(20)],
    *[(7, [0.25] * 64, 0)] * 3,
    (None, [0.125] * 64, 0),
    (None, None, None),
    (61, None, 0),
    (62, [], 0),
    (63, [1.0] * 63, 0),
    (64, [1.0] * 65, 0),
    (65, [1.0] * 63 + [None], 0),
    (66, [1.0] * 63 + [_NAN], 0),
    (67, [_INF] + [1.0] * 63, 0),
    (68, [-_INF] + [1.0] * 63, 0),
    (69, [1e30] + [1.0] * 63, 0),
    (70, [-1e5] + [1.0] * 63, 0),
]
NAMES = ["score", "n_words", "text_hash", "bucket", "h", "shard", "depth", "words", "host", "label", "region", "id", "first", "piece", "kept", "item", "value", "rank", "n", "docs", "size", "terms", "cells", "point", "short", "spans", "items", "text_key", "cell", "_size", "_n", "_bits", "_cell", "c0", "_near_dedup_text_hash", "_rules_host", "bad", "text_hash_________"]


def frame(rows: list[tuple], extra: bool = False) -> pa.Table:
    ids, texts, sources = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
    found = pa.table([ids, texts, [None] * len(ids), sources, [len(x) if x else None for x in texts]], schema=DOCUMENTS)
    for name in NAMES if extra else []:
        found = found.append_column(name, pa.array(["x"] * len(ids), pa.string()))
    return found


def write(folder: Path, rows: list[tuple], extra: bool = False, labels: list[tuple] = (), pages: list[tuple] = (), benchmark: list[tuple] = (), embeddings: list[tuple] = ()) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(frame(rows, extra), folder / "documents.parquet")
    for name, schema, data in (("labels", LABELS, labels), ("pages", PAGES, pages), ("benchmark", BENCHMARK, benchmark), ("embeddings", EMBEDDINGS, embeddings)):
        columns = [list(x) for x in zip(*data, strict=True)] if data else [[] for _ in schema]
        found = pa.table(columns, schema=schema)
        if extra:
            for clashing in {"digest", "text", "point", "words"} - set(found.column_names):
                found = found.append_column(clashing, pa.array(["x"] * len(found), pa.string()))
        pq.write_table(found, folder / f"{name}.parquet")
    return str(folder)


def documents(sf_dir: str) -> pd.DataFrame:
    return pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "source"]).to_pandas()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
