"""A training corpus from raw documents: toxic texts go, then near copies, repeated passages and secrets; what is left is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hireloom.llm.near_dedup import near_dedup
from hireloom.llm.packing import packed
from hireloom.llm.queries import TOKENIZER, Query, table
from hireloom.llm.secrets import secret_scan
from hireloom.llm.shared import new_folder, written
from hireloom.llm.substring_dedup import substring_dedup
from hireloom.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Other columns than those of ``documents`` go too.

    A null, empty or wordless text has no evidence and stays, as does every row
    where no label of either class is known. Rows that repeat, or have a null
    id, are judged each by its text; very long texts are read whole. A score of
    0.5 rejects. An empty table stays empty.
    """
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document of the smallest id stays.

    Rows of one id are one document of several texts: all of them stay or go,
    and of equal rows (id and text) one stays. Rows without an id, and
    documents without words, have no copies and stay.
    """
    kept = near_dedup(docs, shingle=5).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars")
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("at", F.row_number().over(first)).where("at = 1").drop("at")
    return named.union(docs.select(*COLUMNS).where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go; documents without such words keep their text as it is.

    Earlier is the smaller id, a null id comes last, and rows of one id do not
    cut each other. Null texts stay null, empty ones empty. A text that loses
    words has the rest joined by spaces, whatever its length; ``n_chars``
    follows. An empty table stays empty.
    """
    found = substring_dedup(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return found.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark that names their kind.

    Overlapping ones give one mark, of the kind that begins first. Null texts
    stay null; texts without secrets, empty and very long ones included, stay
    as they are. Rows that repeat, or have a null id, are each kept. An empty
    table stays empty.
    """
    found = secret_scan(docs, carry=("lang", "source", "n_chars"), masked=True)
    size = F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("masked_text").cast("long"))
    return found.select("doc_id", F.col("masked_text").alias("text"), "lang", "source", size.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of at most 2048 tokens.

    A null or empty text is the end token alone; a very long one fills whole
    sequences first. Rows that repeat, or have a null id, are packed each;
    pieces of equal length go by id and start. An empty table gives no rows.
    """
    return packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The classifier of the first stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again as the next one's input."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs


QUERY = Query(run, ORACLE_SQL)
