"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; it is written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.

Defined results, for every stage: a null text counts as empty and comes out as the empty text; other columns than those of
documents are left behind, whatever their names; missing lang or source stay null; n_chars is always counted anew; an empty
table gives an empty one; texts of any length are taken whole.  Rows, not doc_ids, go through: rows without a doc_id and
repeated rows are classified, cleaned and redacted one by one, and line dedup counts a doc_id once and leaves rows without one as
they are.  What the join makes of repeats and ties is said at its stage.  Packing returns pieces, with a null doc_id where there was none.
"""

from __future__ import annotations

import public_tokenizers
from lodestar.llm.common import materialize
from lodestar.llm.jaccard import join_documents
from lodestar.llm.lines import dedup_lines
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import good_documents
from lodestar.llm.secrets import redact_documents
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(df: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of documents, n_chars by the text as it is now."""
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    return df.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return as_documents(good_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to many documents stay in one of them."""
    return as_documents(dedup_lines(docs, carry=("lang", "source")), F.col("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays, once.

    Rows are compared, not doc_ids: different texts under one doc_id are each a row of their own, and of several in a
    group the one whose text comes first by hash stays; a row without a doc_id stays unless a group of near copies has
    another one, with a doc_id first.  Blank texts are copies of nothing; only equal ones under one doc_id are one.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = join_documents(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id", "n_shingles")
    own = rows.select("row", "doc_id", F.xxhash64("text").alias("h"))
    blank = F.col("n_shingles") == 0
    group = F.when(blank & F.col("doc_id").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("doc_id").alias("a"), F.col("h").alias("b")))
    group = group.otherwise(F.struct(F.lit(0).alias("kind"), F.col("component_id").alias("a"), F.lit(0).cast("long").alias("b")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h", "row"))
    kept = own.join(found, "row").groupBy(group.alias("g")).agg(first.alias("m")).select(F.col("m.row").alias("row"))
    return as_documents(rows.join(kept, "row", "left_semi"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return as_documents(redact_documents(docs, carry=("lang", "source")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", redact),
    ("best-fit packing", pack),
]

#: No SQL: a classifier's scores and a tokenizer's ids aren't expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
