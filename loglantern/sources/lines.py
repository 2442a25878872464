"""Log lines: from text files and folders, numbered per source, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NOT_BLANK
from ..plans.ordered import number_rows, scan
from ..plans.scratch import stored

# The longest piece of one line, and the lag that marks a stored line as backlog.
PIECE_CHARS = 1 << 20
BACKLOG_SECONDS = 2
STAMP = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{6})?(?:Z|[+-]\d{2}:\d{2}))[ \t]"

LINE_SCHEMA = "host string, seq bigint, ts timestamp, line string"


def is_blank(line: Column) -> Column:
    return ~line.rlike(NOT_BLANK)


def split_pieces(df: DataFrame, line: str = "line", limit: int = PIECE_CHARS) -> DataFrame:
    """A line longer than limit characters becomes several rows, numbered by `piece`."""
    last = F.greatest(F.call_function("div", F.length(line) - 1, F.lit(limit).cast("long")), F.lit(0))
    return df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
        line, F.substr(F.col(line), (F.col("piece") * limit + 1).cast("int"), F.lit(limit))
    )


def read_text_lines(spark: SparkSession, path: str, host: Column | None = None) -> DataFrame:
    """The non-blank lines of text files, split at \\n only, bad UTF-8 replaced, with
    the order columns file, block and place."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        (F.col("_metadata.file_path") if host is None else host).alias("host"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
    ).withColumn("place", F.monotonically_increasing_id())
    return split_pieces(lines).where(~is_blank(F.col("line")))


def read_log_lines(spark: SparkSession, path: str, host: Column | None = None) -> DataFrame:
    """host, seq, line of text files; one file is one source unless host is given."""
    lines = read_text_lines(spark, path, host)
    return number_rows(lines, ["host"], ["file", "block", "place", "piece"]).select("host", "seq", "line")


def number_lines(lines: DataFrame, order: list[str], key: str = "host") -> DataFrame:
    """Number each source's non-blank lines 1.. in the given order. Lines without a source
    are numbered together, as source ''."""
    named = lines.where(~is_blank(F.col("line"))).withColumn(key, F.coalesce(F.col(key), F.lit("")))
    return number_rows(named, [key], order)


def steady_time(lines: DataFrame, key: str = "host") -> DataFrame:
    """Add t, the line time in microseconds that never runs backwards in seq order."""
    return scan(lines, [key], F.unix_micros("ts"), "t", how="max")


def stamped(lines: DataFrame, line: str = "line", key: str = "host") -> DataFrame:
    """Add ts, the time a numbered line begins with (ISO, with its zone), or that of the line before it, and t, its
    microseconds that never run back. Lines before a source's first stamp take that one."""
    own = F.try_to_timestamp(F.regexp_extract(line, STAMP, 1), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"))
    rows = scan(lines.withColumn("_own", own), [key], F.col("_own"), "_last")
    rows = scan(rows, [key], F.col("_own"), "_first", backwards=True)
    return steady_time(rows.withColumn("ts", F.coalesce("_last", "_first")).drop("_own", "_last", "_first"), key)


def read_log(spark: SparkSession, path: str, host: Column | None = None) -> DataFrame:
    """host, seq, line, ts, t of text logs whose lines begin with their time: ready to be labelled."""
    return stamped(read_log_lines(spark, path, host))


def tail_start(lines: DataFrame, last: int | None = None, first: int | None = None, key: str = "host") -> DataFrame:
    """The last lines of every source, or its lines from number `first` on. The ends, a row a source, are
    written first, so that their size is known and the lines need not be moved to meet them."""
    if first is not None:
        return lines.where(F.col("seq") >= first)
    ends = stored(lines.groupBy(key).agg(F.max("seq").alias("_end")), "ends")
    return lines.join(ends, key).where(F.col("seq") > F.col("_end") - last).drop("_end")


def line_time(stored: Column, read: Column, lag: int = BACKLOG_SECONDS) -> Column:
    """The stored time of a line read well after it was stored, else the read time."""
    return F.when(stored < read - F.make_dt_interval(secs=F.lit(lag)), stored).otherwise(read)


def stream_log_lines(spark: SparkSession, path: str, schema: str = LINE_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """New files of lines as they land in a folder (parquet with the given schema)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_text_lines(spark: SparkSession, path: str, host: str | Column | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New text files as they land in a folder, one row per non-blank line, with what orders them; a file is
    a source of its own unless a host is given, by name or as a column (of the file's path). CaptureStream numbers and
    times them."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).select(
        (F.col("_metadata.file_path") if host is None else F.lit(host)).alias("host"), F.make_valid_utf8("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
    return split_pieces(lines).where(~is_blank(F.col("line")))


def catch_up(lines: DataFrame, now: Column, resume_max: int) -> DataFrame:
    """Backlog no older than resume_max seconds before now."""
    return lines.where(F.col("ts") >= now - F.make_dt_interval(secs=F.lit(resume_max)))
