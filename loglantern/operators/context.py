"""Look-back context: the window before an opener, its byte budget, and lines already held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import CaptureParams
from ..plans.ordered import BUCKET, bucket_of, first_reaching, number_rows, scan
from ..plans.scratch import stored

#: Lines of a stretch, in which whole windows meet their lines.
STRETCH = 256


def expand(ranges: DataFrame, low: str, high: str, size: int = BUCKET) -> DataFrame:
    """One row per line number of each [low, high] range, built a bucket at a time."""
    return (
        ranges.where(F.col(low) <= F.col(high))
        .withColumn("_b", F.explode(F.sequence(bucket_of(F.col(low), size), bucket_of(F.col(high), size))))
        .withColumn(
            "seq",
            F.explode(F.sequence(
                F.greatest(F.col(low), F.col("_b") * size), F.least(F.col(high), F.col("_b") * size + size - 1)
            )),
        )
        .drop("_b")
    )


def context_windows(held: DataFrame, params: CaptureParams, size: int = BUCKET) -> DataFrame:
    """The look-back window of every capture, as spans of line numbers: all of it (first_seq to last_seq, n_lines), lines that other
    captures hold included, and what the byte budget leaves of it (kept_first, kept_lines, context_truncated): the oldest lines beyond
    context_bytes go, the newest stays.

    Every line of a window is a captured line, so only `held` is searched. Numbers, times and running bytes of lines rise
    together, so both starts of a window are found in one pass over narrow rows."""
    width = F.octet_length("line").cast("long") + 1
    lines = scan(held.select("host", "seq", "t", "role", width.alias("_width")), ["host"], F.col("_width"), "_to", how="sum", size=size)
    lines = stored(lines.select("host", "seq", "t", "role", (F.col("_to") - F.col("_width")).alias("before")), "sized-lines")
    opens = lines.where(F.col("role") == "open").select(
        "host", F.col("seq").alias("open_seq"), F.col("t").alias("open_t"),
        (F.col("t") - params.window_us).alias("t"), (F.col("before") - params.context_bytes).alias("before"),
    )
    found = first_reaching(lines.drop("role"), opens, ["host"], ["t", "before"], size=size)
    first, last = F.col("t"), F.col("open_seq") - 1
    kept = F.when(first <= last, F.least(F.greatest(first, F.col("before")), last)).otherwise(first)
    return found.select(
        "host", "open_seq", "open_t", first.alias("first_seq"), last.alias("last_seq"), (F.col("open_seq") - first).alias("n_lines"),
        kept.alias("kept_first"), (F.col("open_seq") - kept).alias("kept_lines"), (kept > first).alias("context_truncated"),
    )


def overlapping_context(held: DataFrame, captures: DataFrame, params: CaptureParams, size: int = BUCKET) -> DataFrame:
    """The whole look-back window of every capture as a span of line numbers, lines that other captures hold included."""
    points = held.select("host", "seq", "t")
    probes = captures.select("host", "open_seq", "open_t", (F.col("open_t") - params.window_us).alias("t"))
    found = first_reaching(points, probes, ["host"], ["t"], size=size)
    return found.select(
        "host", "open_seq", "open_t", F.col("t").alias("first_seq"), (F.col("open_seq") - 1).alias("last_seq"),
        (F.col("open_seq") - F.col("t")).alias("n_lines"),
    )


def lookback_context(held: DataFrame, spans: DataFrame, size: int = STRETCH) -> DataFrame:
    """The lines of every whole look-back window; a line in several windows is given for each.

    A window goes to each stretch of `size` lines that it touches, and meets that stretch's lines there, so what is moved is the
    lines once and a row for each window and stretch, not a row for each line of a window. Spark cannot see how many rows the
    stretches of windows are before they are made, so both sides are sorted and neither is broadcast."""
    first, last = F.col("first_seq"), F.col("last_seq")
    wanted = spans.where(first <= last).select(
        "host", "open_seq", first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(bucket_of(first, size), bucket_of(last, size))).alias("_b"),
    )
    lines = held.drop("open_seq", "open_t", "until", "role").withColumn("_b", bucket_of(F.col("seq"), size))
    found = wanted.hint("merge").join(lines, ["host", "_b"]).where(F.col("seq").between(F.col("_first"), F.col("_last")))
    return found.select("host", "seq", "open_seq", *(c for c in lines.columns if c not in ("host", "seq", "_b")))


def cap_context(held: DataFrame, params: CaptureParams, size: int = BUCKET) -> DataFrame:
    """Captured lines without the context lines beyond context_bytes before their opener.
    The context a capture owns runs up to its opener without a gap, so running byte counts
    over the captured lines decide; the newest context line always stays."""
    width = F.octet_length("line").cast("long") + 1
    sized = scan(held.withColumn("_width", width), ["host"], F.col("_width"), "_to", how="sum", size=size)
    opened = F.when(F.col("role") == "open", F.col("_to") - F.col("_width"))
    marked = scan(sized, ["host"], opened, "_open", size=size, backwards=True)
    fits = F.col("_open") - F.col("_to") + F.col("_width") <= params.context_bytes
    keep = (F.col("role") != "context") | (F.col("seq") == F.col("open_seq") - 1) | fits
    return marked.where(keep).drop("_width", "_to", "_open")


def newest_bytes(lines: DataFrame, limit: int, size: int = BUCKET) -> DataFrame:
    """The newest lines of each source that fit in `limit` bytes, and always the newest one."""
    width = F.octet_length("line").cast("long") + 1
    sized = scan(lines.withColumn("_width", width), ["host"], F.col("_width"), "_sum", how="sum", size=size, backwards=True)
    newest = F.col("_sum") == F.col("_width")
    return sized.where((F.col("_sum") <= limit) | newest).drop("_width", "_sum")


def held_ranges(capped: DataFrame, summary: DataFrame, size: int = BUCKET) -> DataFrame:
    """What each capture writes, as one run of line numbers [low_seq, end_seq]: its window
    minus what earlier reusable captures hold, then its own lines. A capture that is not
    `reusable` (unsaved, or moved) holds nothing for later ones. Adds nth, the number of
    reusable captures up to this one."""
    reusable = F.col("reusable") if "reusable" in summary.columns else F.lit(True)
    rows = summary.select("host", "open_seq", "end_seq", reusable.alias("reusable")).join(
        capped.select("host", "open_seq", "kept_first", "context_truncated"), ["host", "open_seq"]
    )
    rows = scan(rows, ["host"], F.when(F.col("reusable"), F.col("end_seq")), "_prev_end",
                seq="open_seq", size=size, inclusive=False)
    rows = scan(rows, ["host"], F.col("reusable").cast("long"), "nth", how="sum", seq="open_seq", size=size)
    return rows.withColumn(
        "low_seq", F.least(F.greatest(F.col("kept_first"), F.coalesce(F.col("_prev_end"), F.lit(0)) + 1), F.col("open_seq"))
    ).drop("_prev_end")


def context_dedup(held: DataFrame, ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    """The context lines each capture writes: none that an earlier reusable capture holds."""
    wanted = ranges.select("host", "open_seq", "low_seq", (F.col("open_seq") - 1).alias("_last"))
    rows = expand(wanted, "low_seq", "_last", size).select("host", "open_seq", "seq")
    return rows.join(held.drop("open_seq", "open_t", "until", "role"), ["host", "seq"])


def written_lines(held: DataFrame, ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    """Everything each capture writes, in seq order: context, then opener and following lines."""
    rows = expand(ranges.select("host", "open_seq", "low_seq", "end_seq"), "low_seq", "end_seq", size)
    lines = held.drop("open_seq", "open_t", "until", "role")
    role = (
        F.when(F.col("seq") < F.col("open_seq"), "context")
        .when(F.col("seq") == F.col("open_seq"), "open")
        .when(F.col("is_match"), "match")
        .otherwise("after")
    )
    return rows.select("host", "open_seq", "seq").join(lines, ["host", "seq"]).withColumn("role", role)


def left_out_counts(ranges: DataFrame, size: int = BUCKET) -> DataFrame:
    """Per capture and earlier reusable capture, the lines of the window it leaves out.

    The holders of a window are consecutive captures, so the pairs come from a span of
    capture numbers and an equi join; only real holders are paired.
    """
    holders = ranges.where(F.col("reusable")).select(
        "host", "nth", F.col("open_seq").alias("held_by_seq"), F.col("low_seq").alias("_low"), F.col("end_seq").alias("_high")
    )
    probes = ranges.select(
        "host", F.col("kept_first").alias("_high"), "kept_first", "open_seq",
        (F.col("nth") - F.col("reusable").cast("long")).alias("_to"),
    )
    spans = first_reaching(holders.select("host", "nth", "_high"), probes, ["host"], ["_high"], seq="nth", size=size)
    pairs = expand(spans.withColumnRenamed("_high", "_from"), "_from", "_to", size).withColumnRenamed("seq", "nth")
    return (
        pairs.join(holders, ["host", "nth"])
        .withColumn(
            "n",
            F.least(F.col("_high"), F.col("open_seq") - 1) - F.greatest(F.col("_low"), F.col("kept_first")) + 1,
        )
        .where(F.col("n") > 0)
        .select("host", "open_seq", "held_by_seq", "n")
    )


def range_coalesce(ranges: DataFrame, key: str = "host", size: int = BUCKET) -> DataFrame:
    """Merge overlapping and adjacent [low, high] ranges per key."""
    rows = number_rows(ranges.select(key, "low", "high"), [key], ["low", "high"], out="_no")
    rows = scan(rows, [key], F.col("high"), "_reach", how="max", seq="_no", size=size, inclusive=False)
    starts = F.col("_reach").isNull() | (F.col("low") > F.col("_reach") + 1)
    rows = scan(rows, [key], F.when(starts, F.col("low")), "_start", seq="_no", size=size)
    return rows.groupBy(key, F.col("_start").alias("low")).agg(F.max("high").alias("high"))
