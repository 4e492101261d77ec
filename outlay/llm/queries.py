"""The registered queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import (
    extraction,
    forest,
    licenses,
    linestore,
    mixing,
    packing,
    periodic,
    pii,
    quality,
    ranked,
    secrets,
    simhash,
    toxicity,
)
from outlay.llm.base import table
from outlay.plans.catalog import Query

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Of the registered queries only; a real corpus gets a secret of its own.
PSEUDONYM_KEY = "registered queries"


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [
        F.size(F.filter("spans", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{name}")
        for k, name in enumerate(secrets.KINDS)
    ]
    digest = F.sha2(secrets.written(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.written(F.col("spans")).alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("licence")), ",").alias("licences"),
        F.size("licence").cast("long").alias("n_matches"),
        F.coalesce(F.array_max("dice"), F.lit(0.0)).alias("best_dice"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymized(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", "n_found")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, sf_dir, "documents"))
    return simhash.components(prints).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(table(spark, sf_dir, "documents"), TOKENIZER))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix.select("doc_id", "size", "source_size", "target", taken)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(quality.text_statistics(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapsed(periodic.repeated(table(spark, sf_dir, "documents"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linestore.without_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_extraction": op1_extraction,
        "op2_secrets": op2_secrets,
        "op3_licenses": op3_licenses,
        "op4_pii": op4_pii,
        "op5_simhash": op5_simhash,
        "op6_packing": op6_packing,
        "op7_toxicity": op7_toxicity,
        "op8_forest": op8_forest,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_periodic": op11_periodic,
        "op12_line_dedup": op12_line_dedup,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": licenses.oracle_sql(),
        "op9_mixing": mixing.ORACLE_SQL,
        "op12_line_dedup": linestore.ORACLE_SQL,
        "op13_ranked_search": ranked.ORACLE_SQL,
    }
