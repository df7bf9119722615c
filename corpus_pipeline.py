"""A training corpus from ``documents`` in five stages.

Each stage gets the rows that its predecessor kept, written as Parquet and
read again, and returns the columns of ``documents``; the last one adds its
shards (a column of the input named like one of these is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import col, free_name, prepare, stored
from pitchline.llm.decontaminate import clean
from pitchline.llm.mixing import copies, mix
from pitchline.llm.sharding import hilbert_shards, measured
from pitchline.llm.simhash import keep_one
from pitchline.llm.toxicity import THRESHOLD, learned_rows, train, with_score
from pitchline.session import scratch_scope


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a null or empty text has the
    model's base score and stays, equal texts have equal scores."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(*learned_rows(docs, labels))
    score = free_name(docs, "score")
    return with_score(docs, model, score).where(F.col(score) < THRESHOLD).select(*[col(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each near-duplicate group; texts without
    words are one group, repeated rows are one, a null id comes last."""
    prepare(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts hold none."""
    prepare(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at each source's cut
    gives its first words only.  Documents without words cost nothing and stay
    once; a null source is a source of its own."""
    prepare(spark)
    return copies(mix(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and place, in Hilbert order; null dimensions first,
    repeated rows side by side."""
    prepare(spark)
    return hilbert_shards(measured(docs))


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

# The classifier and XXH64 have no SQL; tests/llm/test_queries.py has a brute-force version.
# Empty tables give empty results, and further columns pass through every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage keeps between its steps, and
    its predecessor's result, are removed once its own result is written."""
    prepare(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs.scratch_table)
            made.extend([last] if last else [])
        last = docs.scratch_table
    return docs
