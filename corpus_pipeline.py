"""A training-data pipeline: documents go through five stages, each an operator of silvatrack.llm over all that the stage
before it kept. Every stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silvatrack.llm import decontaminate, lang_id, mixing, simhash, token_output
from silvatrack.llm.common import shared_dir


#: Bytes of rows after which an Arrow batch ends. Spark's own limits let a batch of texts grow to tens of MB, which the JVM holds, and
#: the Python worker twice.
BATCH_BYTES = 4 << 20


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with BATCH_BYTES set for the session: results are lazy, so it has to hold when they are written."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject."""
    found = lang_id.identify(docs, lang_id.fit(docs))
    return found.filter(~found[found.columns[-1]]).select(*docs.columns)


@in_small_batches
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash.deduplicate(docs)


@in_small_batches
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


@in_small_batches
def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files, and what is read back from them."""
    return token_output.token_digest(docs)


STAGES = [
    ("language ID", identify_languages),
    ("near duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token files", write_token_files),
]
#: Language ID, SimHash and rounding are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
