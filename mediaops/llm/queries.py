"""The operators on training text on the given tables, one query each, and DuckDB statements where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.llm import (
    huffman,
    licenses,
    lines,
    manifest,
    pieces,
    prints,
    private,
    quality,
    ranked,
    simhash,
    statements,
    suffixes,
    templates,
    toxicity,
)
from mediaops.llm.common import Stages
from mediaops.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return fn(spark, Stages(spark, name), lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        return fn

    return register


@query("op1_simhash_near_duplicates")
def _simhash(spark, stages, table):
    found = simhash.near_duplicates(table("documents"), stages)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op2_huffman_ids")
def _huffman(spark, stages, table):
    return huffman.round_trip(table("documents"), stages, public_tokenizers.path(BYTE_BPE))


@query("op3_sentence_pieces")
def _pieces(spark, stages, table):
    found = pieces.encode(table("documents"), public_tokenizers.path(PIECE_BPE))
    return found.select("doc_id", "n_chars", "n_pieces", "ids_crc32", "same")


@query("op4_toxicity")
def _toxicity(spark, stages, table):
    docs = table("documents")
    found = toxicity.score(docs, toxicity.train(docs, table("labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_toxic", "spans")


@query("op5_repeated_bytes")
def _suffixes(spark, stages, table):
    return suffixes.remove_repeats(table("documents"), stages).drop("spans")


@query("op6_benchmark_templates")
def _templates(spark, stages, table):
    return templates.leaks(table("documents"), table("benchmark"), stages).drop("k1", "k2")


@query("op7_personal_data")
def _private(spark, stages, table):
    docs = table("documents")
    return private.find(docs, private.train(docs))


@query("op8_licence_notices")
def _licenses(spark, stages, table):
    return licenses.scan(table("documents"))


@query("op9_repeated_lines")
def _lines(spark, stages, table):
    found = lines.remove_later_runs(table("documents"), stages)
    return found.select(
        "doc_id",
        F.col("_llm_lines").alias("n_lines"),
        F.col("_llm_gone").alias("n_removed"),
        F.sha2("_llm_kept", 256).alias("kept_sha256"),
    )


@query("op10_fingerprints")
def _prints(spark, stages, table):
    return prints.compare_with_edits(table("documents"), stages)


@query("op11_quality_ratio")
def _quality(spark, stages, table):
    found = quality.judge(table("documents").select("doc_id", "text"), table("labels"), stages)
    return found.drop("text")


@query("op12_merkle_manifest")
def _manifest(spark, stages, table):
    found = manifest.manifest(table("documents"), stages)
    return found.withColumn("n_copied", F.size(F.coalesce("version", F.array().cast("array<binary>"))).cast("long")).drop("version")


@query("op13_ranked_search")
def _ranked(spark, stages, table):
    return ranked.search(table("documents"), table("benchmark"), stages)


ORACLES["op12_merkle_manifest"] = statements.MANIFEST
ORACLES["op13_ranked_search"] = statements.RANKED
