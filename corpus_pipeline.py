"""A training corpus from raw documents: toxic ones go, repeated lines go, one of each group of near copies stays,
benchmark leaks go, and what is left becomes SentencePiece ids. Each stage is one operator of ``mediaops.llm``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.llm import lines, pieces, simhash, templates, toxicity
from mediaops.llm.common import Stages
from mediaops.llm.queries import PIECE_BPE
from mediaops.session import configure

# Texts reach Python in batches of about so many bytes (10,000 rows else, tens of MB): an executor holds several of a batch's
# size in Arrow's buffers and in each worker, and neither gives all of it back to the stages that follow.
BATCH_BYTES = 4 << 20


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with batches of ``BATCH_BYTES`` from then on: its result is computed after it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored 0.7 or more; null ids and texts stay like others."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of runs of lines, n_chars counted anew."""
    found = lines.remove_later_runs(docs, Stages(spark, "pipeline-lines"))
    text = F.when(F.col("text").isNotNull(), F.col("_llm_kept"))
    chars = {"n_chars": F.when(F.col("_llm_gone") > 0, F.char_length("_llm_kept")).otherwise(F.col("n_chars"))}
    chars = {k: v.cast(docs.schema[k].dataType) for k, v in chars.items() if k in docs.columns}
    return found.withColumns({"text": text, **chars}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash links fingerprints within 3 of 64 bits, as op1 does; copies at a
    similarity of 0.8 (five-word shingles) that the bits miss are linked by an exact search after it."""
    linked = simhash.near_duplicates(docs, Stages(spark, "pipeline-simhash"))
    return simhash.keep_first(docs, Stages(spark, "pipeline-copies"), **simhash.SIMILAR, known=linked)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return templates.decontaminate(docs, items, Stages(spark, "pipeline-benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # fewer words kept than by the operator alone: the workers have run four stages before
    found = pieces.encode(docs, public_tokenizers.path(PIECE_BPE), keep=60_000, lasting=False)
    return found.select("doc_id", "n_chars", "n_pieces", "ids", "same")


STAGES = [
    ("toxicity", small_batches(toxic)),
    ("line dedup", small_batches(repeated_lines)),
    ("SimHash near-dedup", small_batches(near_copies)),
    ("benchmark decontamination", small_batches(benchmark)),
    ("SentencePiece", small_batches(sentence_pieces)),
]

# No SQL expresses the fitted field, the fingerprints or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stages.keep(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
