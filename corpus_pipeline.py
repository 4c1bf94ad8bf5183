"""The corpus pipeline: quality, exact and near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again for the next one.  All but the last return the columns of documents.  A stage's table is
removed once the next one is written.

Rows are told apart by identifier and text, so null and repeated identifiers take no other rows along.
Quality: null and empty texts are scored like any other.  Exact and near duplicates: null texts count as
empty; of ties in the identifier any one row stays; in the near stage rows without words all stay.
Benchmark passages: rows without words hold none.  Packing: a null text is the ending id alone.  Long
texts are read whole, repeated rows are equal texts, an empty table stays empty, and extra columns, whatever
their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactloom.llm import decontaminate, exact_dedup, near_dup, packing, quality
from impactloom.llm.common import remove, shared_path, table
from impactloom.llm.queries import tokenizer_path


#: Rows that travel to a Python worker at once; documents are large, and so would be the buffers for more.
BATCH, ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _modest(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest identifier."""
    _modest(spark)
    return exact_dedup.distinct_rows(docs, keep="smallest")


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, similarity 0.8), the document with the smallest identifier."""
    _modest(spark)
    return near_dup.distinct_rows(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences; workers keep no tokenizer, for other stages need the memory."""
    _modest(spark)
    return packing.pack(docs, tokenizer_path(spark), memo_words=100_000, keep_memory=False)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_once),
    ("MinHash near-dedup", near_once),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]
#: Training, MinHash candidates and tokenizing are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = table(spark, sf_dir, "documents")
    batch, before = spark.conf.get(BATCH), None
    try:
        for _, stage in STAGES:
            path = shared_path(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    finally:
        spark.conf.set(BATCH, batch)
    return docs


def _modest(spark: SparkSession) -> None:
    """Stays set when a stage returns, for its plan runs later; ``run`` puts back what was set before."""
    spark.conf.set(BATCH, ROWS_A_BATCH)

