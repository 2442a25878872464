"""Captures as text: file names, the index, the rows of each capture, notes added later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify, strip
from ..params import CaptureParams
from ..plans.ordered import number_rows

# The texts of a rendered capture.
RULE = "-" * 80
PATTERN_ROW = "Matched pattern: "
LINE_ROW = "Matched line:    "
AT_ROW = "Captured at:     "
SINCE_ROW = "Logs since "
INDEX_FOR, INDEX_TO = " Captured logs for ", " to "
MATCH_MARK = "-> "
SELF_MARK = "loglantern-self"

HEADER, NOTES, BODY, TRAILER, ADDED = range(5)


def iso_time(t: Column) -> Column:
    """Microseconds as an ISO date and time; the fraction only when there is one."""
    ts = F.timestamp_micros(t)
    return F.when(F.pmod(t, F.lit(1_000_000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def month_of(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(t), "yyyy-MM")


def group_of(host: Column) -> Column:
    """The part of a month that holds a source's captures: one of 256."""
    return F.left(F.md5(F.coalesce(host, F.lit("")).cast("binary")), F.lit(2))


def stored_in(root: str, month: Column, host: Column) -> Column:
    """The folder that write_rendered puts a capture's rows into."""
    return F.concat(F.lit(f"{root}/month="), month, F.lit("/group="), group_of(host))


def capture_name(captures: DataFrame, root: str) -> DataFrame:
    """Add month, name and path. The name is '<slug>_<open time>.log'; the same
    name again gets -1, -2, ... The path is the folder that holds the capture's rows, and behind a '#' its host and name."""
    base = F.concat(
        F.col("slug"), F.lit("_"), F.date_format(F.timestamp_micros("open_t"), "yyyy-MM-dd'T'HH_mm_ss")
    )
    named = slugify(captures, "pattern").withColumn("_base", base).withColumn("month", month_of(F.col("open_t")))
    numbered = number_rows(named, ["host", "_base"], ["open_seq"], out="_nth")
    again = F.when(F.col("_nth") > 1, F.concat(F.lit("-"), (F.col("_nth") - 1).cast("string"))).otherwise("")
    return (
        numbered.withColumn("name", F.concat("_base", again, F.lit(".log")))
        .withColumn("path", F.concat(stored_in(root, F.col("month"), F.col("host")), F.lit("#"), "host", F.lit("/"), "name"))
        .drop("_base", "_nth")
    )


def capture_index(named: DataFrame) -> DataFrame:
    """One index line for each saved capture."""
    saved = named.where(F.col("reusable")) if "reusable" in named.columns else named
    return saved.select(
        "host", "open_seq",
        F.concat(iso_time(F.col("open_t")), F.lit(INDEX_FOR), "pattern", F.lit(INDEX_TO), "path").alias("entry"),
    )


def body_text(line: Column, is_match: Column) -> Column:
    return F.when(is_match, F.concat(F.lit(MATCH_MARK), strip(line))).otherwise(line)


def _rows(df: DataFrame, part: int, texts: Column) -> DataFrame:
    return df.select("host", "open_seq", F.lit(part).alias("part"), F.posexplode(F.filter(texts, lambda x: x.isNotNull()))).select(
        "host", "open_seq", "part", F.col("pos").cast("long").alias("pos"), F.col("col").alias("text")
    )


def header_rows(captures: DataFrame, params: CaptureParams, captured_at: str) -> DataFrame:
    """Rule, pattern, matched line, time, rule, start of the window, and the note on dropped context."""
    dropped = F.when(
        F.col("context_truncated"),
        F.lit(f"Earlier lines did not fit into {params.context_bytes} bytes of context ..."),
    )
    texts = F.array(
        F.lit(RULE),
        F.concat(F.lit(PATTERN_ROW), F.col("pattern")),
        F.concat(F.lit(LINE_ROW), F.col("opening_line")),
        F.lit(AT_ROW + captured_at),
        F.lit(RULE),
        F.concat(F.lit(SINCE_ROW), iso_time(F.col("open_t") - params.window_us), F.lit(":")),
        dropped,
    )
    return _rows(captures, HEADER, texts)


def left_out_rows(left_out: DataFrame, paths: DataFrame) -> DataFrame:
    """A note per earlier capture that holds lines of this window."""
    where = paths.select("host", F.col("open_seq").alias("held_by_seq"), F.col("path").alias("_path"))
    return left_out.join(where, ["host", "held_by_seq"]).select(
        "host", "open_seq", F.lit(NOTES).alias("part"), F.col("held_by_seq").alias("pos"),
        F.concat(F.col("n").cast("string"), F.lit(" earlier lines stand in "), "_path").alias("text"),
    )


def body_rows(written: DataFrame) -> DataFrame:
    return written.select(
        "host", "open_seq", F.lit(BODY).alias("part"), F.col("seq").alias("pos"),
        body_text(F.col("line"), F.col("is_match")).alias("text"),
    )


def trailer_rows(captures: DataFrame, params: CaptureParams, ended_at: str) -> DataFrame:
    # Over time means that it was still open then: a line cap or the end of the input may come first.
    limit = F.col("open_t") + params.longest_us
    over = F.lit(bool(params.longest_us)) & ((F.col("end_reason") == "time_max") | (F.col("end_t") >= limit))
    texts = F.array(
        F.when(F.col("lines_after") > params.line_count_max, F.lit(f"Stopped by the limit of {params.line_count_max} lines.")),
        F.when(over, F.lit(f"Stopped by the limit of {params.capture_time_max} seconds; the next match opens another capture.")),
        F.lit(RULE),
        F.lit(f"Closed at {ended_at}"),
        F.concat(F.col("lines_after").cast("string"), F.lit(" lines followed the opening one.")),
        F.lit(RULE),
        F.lit(RULE),
    )
    return _rows(captures, TRAILER, texts)


def render_capture(
    captures: DataFrame, written: DataFrame, left_out: DataFrame, params: CaptureParams, captured_at: str, ended_at: str
) -> DataFrame:
    """All text rows of every capture: (host, open_seq, part, pos) is their order."""
    return (
        header_rows(captures, params, captured_at)
        .unionByName(left_out_rows(left_out, captures))
        .unionByName(body_rows(written))
        .unionByName(trailer_rows(captures, params, ended_at))
    )


def append_analysis(rendered: DataFrame, verdicts: DataFrame, mark: str = SELF_MARK) -> DataFrame:
    """Add the verdict, or why there is none, as marked rows after each capture."""
    told = F.concat(
        F.lit("Verdict\ntitle: "), F.col("title"), F.lit("\nnotify: "), F.col("notify").cast("string"),
        F.lit("\nsummary:\n"), F.col("summary"),
    )
    text = F.when(F.col("error").isNull(), told).otherwise(F.concat(F.lit("No verdict: "), F.col("error")))
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
    rows = F.split(F.regexp_replace(text, rf"(?:{ends})\z", ""), ends)
    marked = F.concat(F.array(F.lit("")), F.transform(rows, lambda row: F.concat(F.lit(mark + " "), row)))
    return rendered.unionByName(_rows(verdicts, ADDED, marked))
