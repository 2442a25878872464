"""Reading the corpus tables, and the settings shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by)).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def parts(spark: SparkSession) -> int:
    """Partitions to deal rows into where a count is needed."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def has_words(text: Column) -> Column:
    """Whether a text has a word; false for null."""
    blanks = "\t\n\u000b\f\r "
    return F.coalesce(F.translate(text, blanks, "") != "", F.lit(False))
