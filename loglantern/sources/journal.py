"""Journal export files as entries and lines, and where to go on after a stop."""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import check
from ..plans.ordered import BUCKET, number_rows, scan
from ..plans.scratch import stored
from .lines import is_blank, steady_time, tail_start

# The export fields a line needs, the bytes kept of one, and a cursor's form.
FIELDS = {
    b"__CURSOR": "cursor", b"__REALTIME_TIMESTAMP": "stored", b"_SOURCE_REALTIME_TIMESTAMP": "source",
    b"_HOSTNAME": "host", b"SYSLOG_IDENTIFIER": "ident", b"_COMM": "comm", b"_PID": "pid",
    b"SYSLOG_PID": "syslog_pid", b"MESSAGE": "message",
}
FIELD_MAX = 4 << 20
READ_BYTES = 1 << 20
#: Bytes of a file that one task decodes.
STRETCH_BYTES = 64 << 20
FIELD_NAME = re.compile(rb"[A-Z0-9_]+")
CURSOR = re.compile(r"s=[0-9a-f]{32};i=[0-9a-f]{1,16};b=[0-9a-f]{32};m=[0-9a-f]{1,16};t=[0-9a-f]{1,16};x=[0-9a-f]{1,16}")

RAW_COLUMNS = ["file", "place", *FIELDS.values()]
RAW_SCHEMA = ", ".join(f"{c} {'bigint' if c == 'place' else 'string'}" for c in RAW_COLUMNS)


def _opened(path: str):
    """A file of any store as a stream that can be placed."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb", READ_BYTES)
    store, name = FileSystem.from_uri(path)
    return io.BufferedReader(store.open_input_file(name), READ_BYTES)


def _items(stream, at: int):
    """(name, value, offset behind it) of the fields from a record's start on, ('', None, offset) at a record's end, and a name of
    None for lines that are no field. Values are as long as is kept of one. Nothing is given for an item that is cut off."""
    stream.seek(at)
    while True:
        line = stream.readline(FIELD_MAX)
        at, more = at + len(line), line
        while not more.endswith(b"\n"):
            if not (more := stream.readline(FIELD_MAX)):
                return
            at += len(more)
        name, equals, value = line.removesuffix(b"\n").partition(b"=")
        if equals:
            yield name, value, at
        elif not name:
            yield b"", None, at
        elif more is line and FIELD_NAME.fullmatch(name):
            size = int.from_bytes(stream.read(8), "little")
            value = stream.read(min(size, FIELD_MAX)) if name in FIELDS else b""
            at += 8 + size + 1
            stream.seek(at - 1)
            if not stream.read(1):
                return
            yield name, value, at
        else:
            yield None, None, at


def _cut_points(every: int):
    """Cut each file (path) at record starts, `every` bytes apart or the next start after that. A binary field may hold what
    looks like records, so a file's starts are found in order; its values are passed over by their lengths, not read."""

    def rows(batches):
        for batch in batches:
            for path in batch["path"]:
                start, found = 0, []
                with _opened(path) as stream:
                    for name, _, at in _items(stream, 0):
                        if name == b"" and at - start >= every:
                            found.append((path, start, at))
                            start = at
                    yield pd.DataFrame([*found, (path, start, None)], columns=["path", "start", "stop"]).astype({"start": "Int64", "stop": "Int64"})

    return rows


def _decode(batches):
    """The records of each stretch of a file; `place` is the offset that a record begins at."""
    for batch in batches:
        for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
            rows, fields, began = [], {}, int(start)
            with _opened(path) as stream:
                for name, value, at in _items(stream, began):
                    if name == b"":
                        if "cursor" in fields and fields.get("stored", b"").isdigit():
                            text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
                            rows.append([path, began, *[text.get(c) for c in FIELDS.values()]])
                        fields, began = {}, at
                        if not pd.isna(stop) and at >= stop:
                            break
                    elif name in FIELDS:
                        fields[FIELDS[name]] = value
                    if len(rows) >= 10000:
                        yield pd.DataFrame(rows, columns=RAW_COLUMNS)
                        rows = []
            yield pd.DataFrame(rows, columns=RAW_COLUMNS)


def _entries(files: DataFrame, tasks: int, every: int) -> DataFrame:
    """The entries of files (path), each read by as many tasks as it has stretches of `every` bytes."""
    cuts = files.select("path").mapInPandas(_cut_points(every), "path string, start bigint, stop bigint")
    raw = cuts.repartition(tasks, "path", "start").mapInPandas(_decode, RAW_SCHEMA)
    digits = F.col("source").rlike(r"\A[0-9]+\z")
    return raw.select(
        "file", "place", "cursor", F.col("stored").try_cast("bigint").alias("stored_us"),
        F.when(digits, F.col("source").try_cast("bigint")).alias("source_us"),
        "host", "ident", "comm", "pid", "syslog_pid", "message",
    )


def read_journal_export(spark: SparkSession, path: str, every: int = STRETCH_BYTES) -> DataFrame:
    """The entries of export files, of any size. One task finds a file's cuts, at record starts; its stretches are then read by tasks of
    their own, as streams, so that a task holds a few fields at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read here
    total = files.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // every))
    return _entries(files, tasks, every)


def stream_journal_export(spark: SparkSession, path: str, files_per_batch: int | None = None, every: int = STRETCH_BYTES) -> DataFrame:
    """The entries of export files as they land in a folder."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _entries(reader.load(path), int(spark.conf.get("spark.sql.shuffle.partitions")), every)


def stream_journal_lines(entries: DataFrame) -> DataFrame:
    """Entries of a stream as CaptureStream takes them: lines in order of when they were stored, `at` being that time."""
    rows = journal_to_lines(entries.withColumn("_source", F.coalesce("host", F.lit(""))))
    at = F.timestamp_micros("stored_us")
    return rows.select(
        F.col("_source").alias("host"), "line", at.alias("changed"), at.alias("at"), "file", F.col("place").alias("block"), F.col("part").cast("int").alias("piece"),
    )


def journal_to_lines(entries: DataFrame) -> DataFrame:
    """Entries as short-iso lines, one row per line of a message with its `part`. Later lines are
    indented by the width of the prefix; an entry without a message gives none."""

    def named(*columns: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])

    second = F.call_function("div", F.coalesce(F.col("source_us"), F.col("stored_us")), F.lit(1_000_000).cast("long"))
    stamp = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ssxxx")
    host = F.coalesce(F.concat(F.lit(" "), named("host")), F.lit(""))
    ident = F.coalesce(named("ident", "comm"), F.lit("unknown"))
    pid = F.coalesce(F.concat(F.lit("["), named("pid", "syslog_pid"), F.lit("]")), F.lit(""))
    prefix = F.concat(stamp, host, F.lit(" "), ident, pid, F.lit(": "))
    keys = [c for c in entries.columns if c not in ("message", "comm", "syslog_pid", "ident", "pid")]
    rows = entries.where(F.col("message").isNotNull()).select(
        *keys, prefix.alias("_prefix"), F.posexplode(F.split("message", "\n", -1)).alias("part", "_text")
    )
    indent = F.rpad(F.lit(""), F.length("_prefix"), F.lit(" "))
    line = F.when(F.col("part") == 0, F.concat("_prefix", "_text")).otherwise(F.concat(indent, "_text"))
    return rows.withColumn("line", line).drop("_prefix", "_text").where(~is_blank(F.col("line")))


def journal_log(entries: DataFrame) -> DataFrame:
    """host, seq, line, ts, t of entries as they were stored: ready to be labelled. An entry without a host is of source ''."""
    rows = journal_to_lines(entries.withColumn("_source", F.coalesce("host", F.lit(""))))
    order = [c for c in ("stored_us", "file", "place", "cursor", "part") if c in rows.columns]
    rows = rows.drop("host").withColumnRenamed("_source", "host").withColumn("ts", F.timestamp_micros("stored_us"))
    numbered = number_rows(rows, ["host"], order)
    return steady_time(numbered).select("host", "seq", "line", "ts", "t")


@dataclass(frozen=True)
class Position:
    """The last entry read, and the second it was stored."""

    cursor: str | None
    time: int


def resume_slice(
    entries: DataFrame,
    position: Position | None,
    now: int,
    capture_time: int,
    resume_max: int,
    tail: int = 20,
    any_cursor: bool = False,
    size: int = BUCKET,
) -> DataFrame:
    """What to read after a stop, from the entries of one journal (host, seq, cursor, stored
    in seconds): rows with role match or context, and their time.

    Found: everything after the saved entry is matched; before it, entries back to the
    first one stored earlier than the look-back are context, whose times never run backwards.
    Not found: everything since then is matched. Too old: everything of the last resume_max
    seconds. No position, or one in the future that is gone: the last `tail` lines.
    """
    check(resume_max=resume_max, capture_time=capture_time)
    read = F.lit(now)
    stored_at = F.col("stored")
    late = F.when(stored_at < read - 2, stored_at).otherwise(read)
    if position is None:
        return tail_start(entries, last=tail).withColumn("role", F.lit("match")).withColumn("time", late)
    if now - position.time > resume_max:
        return entries.where(stored_at >= now - resume_max).withColumn("role", F.lit("match")).withColumn("time", late)
    since = max(position.time - capture_time, now - resume_max)
    usable = position.cursor is not None and (any_cursor or CURSOR.fullmatch(position.cursor))
    saved = entries.where(F.col("cursor") == position.cursor).select("seq").first() if usable else None
    if saved is None:
        if position.time > now + 60:
            return tail_start(entries, last=tail).withColumn("role", F.lit("match")).withColumn("time", late)
        return entries.where(stored_at >= since).withColumn("role", F.lit("match")).withColumn("time", late)
    at = saved["seq"]
    older = entries.where((F.col("seq") <= at) & (stored_at < since)).agg(F.max("seq").alias("seq")).first()["seq"] or 0
    after = entries.where(F.col("seq") > at).withColumn("role", F.lit("match")).withColumn("time", late)
    before = entries.where((F.col("seq") > older) & (F.col("seq") <= at)).withColumn("role", F.lit("context"))
    before = scan(before, ["host"], stored_at, "_time", how="min", size=size, backwards=True)
    return after.unionByName(before.withColumn("time", F.least("_time", read)).drop("_time"))


def resume_by_host(entries: DataFrame, positions: DataFrame, now: int, capture_time: int, resume_max: int, tail: int = 20, size: int = BUCKET) -> DataFrame:
    """resume_slice for every source by its own position: positions is a table as position_of gives it (host, cursor, time).

    A source without a position starts with its last `tail` lines. Positions, ends and bounds are a row a source, and
    written, so that the entries stay where they are."""
    check(resume_max=resume_max, capture_time=capture_time)
    stored_at, late = F.col("stored"), F.when(F.col("stored") < now - 2, F.col("stored")).otherwise(F.lit(now))
    ends = entries.groupBy("host").agg(F.max("seq").alias("_end"))
    saved = positions.select("host", F.col("cursor").alias("_cursor"), F.col("time").alias("_time"))
    known = stored(ends.join(saved, "host", "left"), "positions")
    at = entries.join(known, "host").where(F.col("cursor") == F.col("_cursor")).groupBy("host").agg(F.max("seq").alias("_at"))
    known = known.join(at, "host", "left").withColumn("_since", F.greatest(F.col("_time") - capture_time, F.lit(now - resume_max)))
    case = (
        F.when(F.col("_time").isNull(), "tail")
        .when(now - F.col("_time") > resume_max, "old")
        .when(F.col("_at").isNotNull(), "found")
        .when(F.col("_time") > now + 60, "tail")
        .otherwise("lost")
    )
    known = stored(known.withColumn("_case", case), "positions")
    older = entries.join(known, "host").where((F.col("seq") <= F.col("_at")) & (stored_at < F.col("_since")))
    known = stored(known.join(older.groupBy("host").agg(F.max("seq").alias("_older")), "host", "left"), "positions")
    rows = entries.join(known, "host")
    found = F.col("_case") == "found"
    matched = (
        F.when(found, F.col("seq") > F.col("_at"))
        .when(F.col("_case") == "tail", F.col("seq") > F.col("_end") - tail)
        .when(F.col("_case") == "old", stored_at >= now - resume_max)
        .otherwise(stored_at >= F.col("_since"))
    )
    own = [c for c in entries.columns]
    after = rows.where(matched).select(*own, F.lit("match").alias("role"), late.alias("time"))
    before = rows.where(found & (F.col("seq") <= F.col("_at")) & (F.col("seq") > F.coalesce("_older", F.lit(0)))).select(*own)
    before = scan(before, ["host"], stored_at, "_low", how="min", size=size, backwards=True)
    return after.unionByName(before.select(*own, F.lit("context").alias("role"), F.least("_low", F.lit(now)).alias("time")))


def position_of(entries: DataFrame) -> DataFrame:
    """The position to save: the cursor and second of the last entry of each source."""
    return entries.groupBy("host").agg(F.max_by("cursor", "seq").alias("cursor"), F.max_by("stored", "seq").alias("time"))
