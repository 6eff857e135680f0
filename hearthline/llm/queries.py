"""Queries of this subpackage by name, and the SQL that those equal which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import centroids, divergence, fixity, licenses, line_rules, multiset, near_dedup, packing, pieces, quality_mil, sharding, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extendible_shards": sharding.op1_extendible_shards,
    "shard_directory": sharding.shard_directory,
    "op2_quality": quality_mil.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_multiset": multiset.op4_multiset,
    "op5_line_rules": line_rules.op5_line_rules,
    "clean_lines": line_rules.clean_lines,
    "op6_fixity": fixity.op6_fixity,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_licenses": licenses.op8_licenses,
    "op9_pieces": pieces.op9_pieces,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_divergence": divergence.op11_divergence,
    "op12_centroids": centroids.op12_centroids,
    "op13_suffix_arrays": suffixes.op13_suffix_arrays,
}

ORACLES: dict[str, str] = {
    "op1_extendible_shards": sharding.ORACLE,
    "shard_directory": sharding.DIRECTORY_ORACLE,
    "op5_line_rules": line_rules.ORACLE,
    "clean_lines": line_rules.CLEAN_ORACLE,
    "op6_fixity": fixity.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_suffix_arrays": suffixes.ORACLE,
}
