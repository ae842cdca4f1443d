"""A corpus pipeline over documents. Each stage takes all that its predecessor kept, as a DataFrame with the columns of
documents, and applies one operator: quality rules, near-duplicates, personal data, source mixing, packing.

Stages key rows by a number of their own, given by their place in the files they are read from, so repeated ids do not
mix up rows; every document is judged by the whole of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm import mixing, packing, pii, quality, simhash
from cartograph.llm.common import materialize, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    rows = _rows(docs)
    kept = quality.judge(rows, id_col=ROW).where("kept").select(F.col("doc_id").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts whose five-word shingles are 0.8 alike or more."""
    ship(spark)
    rows = _rows(docs)
    first = simhash.distinct_rows(rows, 0.8, 5, row_col=ROW, order="doc_id").withColumnRenamed("row", ROW)
    return rows.join(materialize(first), ROW, "left_semi").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the kind in brackets."""
    found = pii.find(docs.select(*COLUMNS), keep=("text", "lang", "source"))
    out = found.select("doc_id", F.when(F.col("text").isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col("spans"))).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; sources weigh 1, 2, 3, repeating."""
    rows = _rows(docs)
    taken = mixing.mix(rows, (1, 2, 3), 3, id_col=ROW).select(F.col("doc_id").alias(ROW), "copies").where("copies > 0")
    return rows.join(taken, ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(packing.token_pieces(docs, "byte_bpe_50k.json", end_id=0, capacity=2048), 2048)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: None: shingle fingerprints, Newton steps and BPE have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
