"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. Scratch data
of a stage is deleted when the next one begins, as its result is stored then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, decontaminate, jaccard, line_dedup, ordinal, queries, shared

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(body: Stage) -> Stage:
    @wraps(body)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.release_scratch(spark, "pipeline")
        with shared.scratch_owner("pipeline"):
            return body(spark, docs, sf_dir)

    return stage


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade is large enough; the rest go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.fit_grades(docs, ordinal.quality_grades(labels), n_grades=3)
    scored = ordinal.score_grades(docs, model, tail=2)
    return scored.where(F.col("tail_probability") >= queries.KEEP_TAIL).select(*docs.columns)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that fuzzily occur before; no document goes."""
    slim = line_dedup.dedup_lines(docs, wide=True, short=True)
    return slim.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by close SimHashes and a Jaccard similarity of 0.8 or more over five-word shingles."""
    return jaccard.drop_near_duplicates(docs, shingle=5)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_texts_column(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminated),
    ("byte-level bpe", tokenize),
]

#: Two stages train a model or walk edit distances: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return result
        path = f"{shared.scratch_root(spark)}/stage-{number}-{shared.fresh_name()}"
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
