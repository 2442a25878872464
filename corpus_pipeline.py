"""Documents to training data in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.mixing import mixed_documents
from loglantern.llm.near_dups import near_duplicates
from loglantern.llm.passages import without_repeats
from loglantern.llm.pieces import encoded, read_vocabulary
from loglantern.llm.tables import has_words, table
from loglantern.llm.toxicity import THRESHOLD, learn_from, learned, toxicity
from loglantern.plans.scratch import stored

SHINGLE_WORDS, PERCENT = 5, 80
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch that goes to a Python worker, at most. Spark's 10,000 are tens of MB of texts, held by the JVM and the worker.
BATCH_ROWS = 1024


def in_small_batches(stage):
    """The stage in a session of batches of at most BATCH_ROWS; that stays set, as a stage's last job runs after it returns."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = int(spark.conf.get(ARROW_ROWS))
        spark.conf.set(ARROW_ROWS, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def leave_out_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, learned from the labels that may be learned from."""
    grammar = learned(docs, learn_from(table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return toxicity(docs, grammar).filter(F.col("_score") < THRESHOLD).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group; one row of it where rows are repeated. Texts without words all stay.

    A group is a component of linked texts, whatever their ids: null or tied ids make no group of texts that are not linked.
    Of a group's several texts of the least id (or of none), that of the least hash stays."""
    found = near_duplicates(docs, k=SHINGLE_WORDS, percent=PERCENT).filter("kept AND n_shingles > 0")
    stay = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("_stays"))
    stay = stored(stay.select("_stays.doc_id", "_stays.text_hash"), "stay")
    worded = docs.filter(has_words(F.col("text"))).withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"])
    same = worded["doc_id"].eqNullSafe(stay["doc_id"]) & (worded["_hash"] == stay["text_hash"])
    return worded.join(stay.hint("merge"), same, "left_semi").select(*docs.columns).unionByName(docs.filter(~has_words(F.col("text"))))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that repeat; a text without any is unchanged."""
    rows = without_repeats(docs)
    new = {"text": F.when(F.col("_n_removed") > 0, F.col("_kept_text")).otherwise(F.col("text")).alias("text")}
    new["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("_kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*(new.get(c, F.col(f"`{c}`")) for c in docs.columns))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each pass over a document in which the mix takes words of it."""
    return mixed_documents(docs)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and whether they decode to it."""
    rows = encoded(docs, read_vocabulary(), check=True)
    return rows.select("doc_id", "lang", "source", F.coalesce(F.size("_pieces"), F.lit(0)).alias("n_pieces"), F.col("_pieces").alias("pieces"), F.col("_same").alias("round_trip"))


STAGES = [
    ("toxicity", in_small_batches(leave_out_toxic)),
    ("near duplicates", in_small_batches(one_of_near_duplicates)),
    ("repeated passages", in_small_batches(without_repeated_passages)),
    ("mixing", in_small_batches(mixed_to_weights)),
    ("pieces", in_small_batches(in_pieces)),
]

#: SQL cannot express the stages that learn, draw and encode; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
