"""A corpus pipeline of five stages over ``documents``.

Each stage takes all rows that the one before kept, as a table read back from Parquet, and returns the columns of
``documents``; the last returns what the mix takes of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.llm import decontaminate, lines, mixing, neardup, toxicity
from mapql.runtime import Tables


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by its text alone, so repeated ids and rows without one are no matter; a null or empty text
    has the score of the sample's shares; without labels all stay; an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _free(docs, "_toxic")
    clean = F.lit(True) if not model.gain.any() else F.col(name) < toxicity.THRESHOLD
    return toxicity.score(docs, model, name).where(clean).drop(name)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that match an earlier one go, and with them documents that lose all they had.

    Rows that repeat an id are one document in the order of lines, rows without an id come last in it; a text
    without words stays as it is; an empty table stays empty.
    """
    out = lines.dedup_lines(docs).where("_removed < _lines OR _lines = 0")
    return out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_lines", "_removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document of the smallest id stays.

    Rows that repeat an id are one document, which stays or goes whole. A row without an id is a document of its
    text, after all those that have one. A text without words stays; an empty table stays empty.
    """
    key = _free(docs, "_key")
    by_text = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), by_text))
    gone = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Rows are known by their texts, so one that is hit goes with its equals only, whatever their ids; a null or empty
    text stays; an empty benchmark or table changes nothing.
    """
    key = _free(docs, "_text")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = decontaminate.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document.

    Rows without a source are a source of their own; a text without words gives nothing; rows that repeat an id stay
    apart; an empty table gives an empty table.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The first stage is a trained model, which SQL can't express. tests/llm/test_sql.py tests the stages against plain versions, of the first the threshold only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read back."""
    tables, before = Tables(spark, "stages"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = tables.put(stage(spark, docs, sf_dir))
        if before:
            tables.free(before)
        before = docs
    return docs
