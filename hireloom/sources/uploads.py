"""Registration of uploaded resume files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.text import str_map, strip


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """File name, type by extension, and content of every file under a folder."""
    by_extension = str_map({ext: mime for mime, ext in vocab.UPLOAD_TYPES.items()})
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        name.alias("filename"),
        F.try_element_at(by_extension, F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))).alias(
            "mime_type"
        ),
        "content",
    )


def safe_title(filename: Column) -> Column:
    base = strip(F.element_at(F.split(filename, "/"), -1))
    safe = F.substring(F.regexp_replace(base, r"(?U)[^\w.\- ()]+", "_"), 1, 255)
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("Resume"))


def register(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files with title, checksum and extension; rejected ones with a reason."""
    mime = F.lower(F.trim(F.split(F.coalesce("mime_type", F.lit("")), ";")[0]))
    types = str_map(vocab.UPLOAD_TYPES)
    size = F.octet_length("content")
    reason = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file")
        .when(size > vocab.UPLOAD_MAX_BYTES, "file_too_large")
        .when(F.try_element_at(types, mime).isNull(), "unsupported_type")
    )
    judged = files.select(
        "filename",
        mime.alias("mime_type"),
        size.cast("bigint").alias("n_bytes"),
        F.sha2("content", 256).alias("checksum"),
        safe_title(F.col("filename")).alias("title"),
        F.try_element_at(types, mime).alias("extension"),
        reason.alias("reason"),
    )
    return (
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()).select("filename", "mime_type", "reason"),
    )
