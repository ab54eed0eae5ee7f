"""Corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's docs; the first three return the columns of ``documents``, the last one pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinmap.llm.common import kept_table, tokenizer_path
from veinmap.llm.near_texts import near_texts, tie_of
from veinmap.llm.packing import pack
from veinmap.llm.pii import redact
from veinmap.llm.quality import apply_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule accepts, row by row: repeated rows and ids fare alike, null and blank texts are
    rejected as too short, an empty table gives an empty one; all columns stay as they are."""
    return apply_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id (then the smallest text hash).

    Groups go by the component's root, since several may share their smallest id or have none. Rows are told
    apart by id and text hash, a null id counting as the smallest; of rows equal in both, any one stays, as they are
    duplicates whatever their other columns hold. Documents without words aren't duplicates of anything and all
    stay. An empty table gives an empty one.
    """
    found = near_texts(docs)
    alone = F.col("node").isNull()
    groups = found.filter(~alone).groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    kept = groups.select(F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie"), F.lit(False).alias("__row_alone"))
    kept = kept.unionByName(found.filter(alone).select("doc_id", "tie", F.lit(True).alias("__row_alone")).distinct())
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__row_id"), F.col("tie").alias("__row_tie"), "__row_alone"]
    rows = docs.withColumn("__row_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("__row_tie", tie_of(F.col("text")))
    rows = rows.join(kept.select(*key), ["__row_id", "__row_tie"])
    nth = F.row_number().over(Window.partitionBy("__row_id", "__row_tie").orderBy("__row_tie"))
    return rows.withColumn("__row_nth", nth).filter("__row_alone or __row_nth = 1").select(*[docs[c] for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind, row by row; null texts stay null, and
    ``n_chars`` follows the text. Ties, repeated rows and an empty table need no rule."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids, in the order of the ids, null ids first and equal ones by text hash; a null text is its
    end id alone, repeated rows are packed as often as they occur, an empty table gives no piece."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packing)]

#: SQL can't encode by a tokenizer's vocabulary; the tests hold the result against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept_table(docs, "stage")
    return docs
