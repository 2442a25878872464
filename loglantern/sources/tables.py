"""Log tables derived from the benchmark's event, document, order and label tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import OwnIdentity, PatternSet, label_lines
from ..params import CaptureParams
from ..plans.scratch import scratch_path
from .lines import is_blank, number_lines

WATCH = PatternSet.of(
    regexes=[r"purchase\[\d+7\]", r'"k": 9\d', r"click user \d+ .*: 1\}"],
    texts=["error user 1", "signup user 3", "sign?p user [2-4]5", "view user"],
)
ALWAYS = PatternSet.of(regexes=[r"error user \d+ "], texts=["k\": 95"])
OWN = OwnIdentity(idents=("view",), marker="self-marker", needle="/self.py")
PARAMS = CaptureParams(capture_time=7200, capture_time_max=14400, line_count_max=5, context_bytes=200)
DOC_PATTERNS = PatternSet.of(regexes=["ation"], texts=["the ", "q?e", "[aeiou]ch"])

_ready: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as unnumbered log lines of eight hosts."""
    user = F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host"),
        "event_id",
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("event_type").alias("ident"),
        user.alias("pid"),
        F.concat_ws(" ", "event_type", F.lit("user"), user, "props").alias("message"),
    )
    return rows.withColumn(
        "line",
        F.concat(iso_stamp(F.col("ts").cast("timestamp")), F.lit(" "), "host", F.lit(" "), "ident", F.lit("["), "pid", F.lit("]: "), "message"),
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table built by `build()` the first time a session asks for it, then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _ready:
        try:
            return spark.read.parquet(_ready[key])
        except AnalysisException:
            del _ready[key]
    path = scratch_path(spark, name)
    build().write.parquet(path)
    _ready[key] = path
    return spark.read.parquet(path)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, seq, ts, t, line and the event's parts, numbered per host."""
    return once(spark, sf_dir, "log_lines", lambda: number_lines(raw_lines(spark, sf_dir), ["t", "event_id"]))


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_lines with label and always: the table every capture query starts from."""
    return once(
        spark, sf_dir, "labelled_lines",
        lambda: label_lines(log_lines(spark, sf_dir).select("host", "seq", "ts", "t", "line"), WATCH, ALWAYS, OWN),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as lines: doc_id, line_no, line."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(~is_blank(F.col("line"))).withColumn("line_no", F.col("line_no").cast("long"))
