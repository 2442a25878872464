"""Captures from a stream of lines, one micro-batch at a time, with the batch operators.

Between batches only what the next one can still need is kept, as small tables in the
state folder: recent lines no capture holds yet, the matches of captures still open, and
where each source ended. A batch reads the state of the batch before it and writes its
own output and state under its number, so a batch that runs again after a failure
replaces exactly what it wrote the first time.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.captures import always_notify_rollup, capture_lines, capture_summary, find_captures, match_rows
from ..operators.context import cap_context, newest_bytes
from ..operators.excerpts import excerpt_around_match, excerpt_json_capped, place_rows
from ..operators.matching import OwnIdentity, PatternSet, label_lines
from ..operators.rendering import capture_name, render_capture
from ..operators.requests import event_payload, model_request, parse_verdict, push_request, route_capture
from ..operators.retention import write_rendered
from ..params import CaptureParams, RequestParams
from ..plans.ordered import BUCKET, number_rows, scan
from ..plans.scratch import _remove, scratch_path, scratch_scope, stored
from ..sources.lines import stamped

LINES = "host string, seq bigint, ts timestamp, t bigint, line string, label string, always boolean"
MATCHES = "host string, seq bigint, t bigint"
ENDS = "host string, end_seq bigint, end_t bigint, late bigint"
OPEN = (
    "host string, open_seq bigint, open_t bigint, until bigint, seq bigint, ts timestamp, t bigint, role string, is_match boolean, "
    "line string, label string, always boolean, truncated boolean"
)
TICK = "host string, seq bigint, ts timestamp, line string"

#: Folder of the markers of ended batches.
MARKERS = "committed"

Patterns = Callable[[SparkSession, int], tuple[PatternSet, PatternSet]]


def fixed(patterns: PatternSet, always: PatternSet = PatternSet()) -> Patterns:
    """The same patterns for every batch. A function that reads the pattern files instead
    makes a changed file count from the next batch on."""
    return lambda spark, batch: (patterns, always)


@dataclass
class CaptureStream:
    """Settings of one stream: where it writes, where it keeps state, and how many seconds may pass before a silent
    source's open capture is closed, and before a line behind its own source's newest counts as late (None: never).

    Under output are written, a folder a batch: lines (captured lines), closed (captures with all that is known of
    them), texts (their rendered rows), late (lines too late to be read in order), and, with requests, pushes and events."""

    output: str
    state: str
    patterns: Patterns
    params: CaptureParams = CaptureParams()
    own: OwnIdentity | None = None
    delay: int | None = None
    size: int = BUCKET
    session: SparkSession | None = None
    requests: RequestParams | None = None
    #: Seconds within which a line that comes again, by source and number, is dropped unseen (None: it counts as late).
    unique: int | None = None
    #: Secret part of the marks around log data in model requests.
    salt: str = field(default_factory=lambda: secrets.token_hex(16))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        """Run a batch. What it writes counts from the moment its marker is there, and not before: a batch that is killed
        between two tables shows nothing of itself."""
        spark = self.session or rows.sparkSession
        if batch == 0:
            self._unused(spark)
        _remove(spark, f"{self.output}/{MARKERS}/batch={batch}")
        with scratch_scope(spark):
            self._run(rows, batch)
        spark.range(1).write.mode("overwrite").parquet(f"{self.output}/{MARKERS}/batch={batch}")

    def _run(self, rows: DataFrame, batch: int) -> None:
        # The batch is written once; the rest reads it as an ordinary table, with the caller's session settings.
        spark = self.session or rows.sparkSession
        path = scratch_path(spark, "arrived")
        rows.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
        arrived = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, place bigint").parquet(path)
        lookback, matched, ends, begun = (
            self._state(spark, batch, name, schema) for name, schema in (("lines", LINES), ("matches", MATCHES), ("ends", ENDS), ("open", OPEN))
        )
        params = self.params
        ticked = arrived.where("host IS NULL").agg(F.max(F.unix_micros("ts")).alias("t")).first()["t"] if "ts" in rows.columns else None

        late = F.coalesce(F.col("seq") <= F.col("end_seq"), F.lit(False))
        if self.delay is not None:
            late = late | F.coalesce(F.unix_micros("ts") < F.col("end_t") - self.delay * 1_000_000, F.lit(False))
        taken = self._in_order(arrived.where("host IS NOT NULL"), ends).join(ends, "host", "left").withColumn("_late", late)
        taken = stored(taken, "taken")
        taken.where("_late").select("host", "seq", "ts", "line").write.mode("overwrite").parquet(f"{self.output}/late/batch={batch}")
        fresh = scan(taken.where(~F.col("_late")), ["host"], F.unix_micros("ts"), "t", how="max", size=self.size)
        fresh = fresh.withColumn("t", F.greatest("t", "end_t")).select("host", "seq", "ts", "t", "line")
        watch, always = self.patterns(spark, batch)
        labelled = stored(label_lines(fresh, watch, always, self.own), "batch_lines")

        lines = lookback.unionByName(labelled)
        matches = matched.unionByName(match_rows(labelled))
        captures = stored(find_captures(matches, params, self.size), "batch_captures")
        held = stored(capture_lines(lines, captures, params, self.size), "batch_held")
        capped = stored(cap_context(held, params, self.size), "batch_capped")
        capped.write.mode("overwrite").parquet(f"{self.output}/lines/batch={batch}")

        counted = taken.groupBy("host").agg(
            F.max(F.when(~F.col("_late"), F.col("seq"))).alias("end_seq"),
            F.count_if("_late").alias("late"),
        ).join(labelled.groupBy("host").agg(F.max("t").alias("end_t")), "host", "left")
        now = stored(
            ends.unionByName(counted).groupBy("host")
            .agg(F.max("end_seq").alias("end_seq"), F.max("end_t").alias("end_t"), F.sum("late").alias("late")),
            "batch_ends",
        )
        full = held.where(F.col("seq") == F.col("open_seq") + params.reach).select("host", "open_seq", F.lit(True).alias("full"))
        judged = stored(captures.join(now, "host").join(full, ["host", "open_seq"], "left"), "judged")
        is_closed = self._closed(self._watermark(now, ticked))
        closed = judged.where(is_closed).withColumn("end_reason", self._reason()).drop("end_seq", "end_t", "late", "full")

        # what is known of captures that are still open goes on to the next batch
        key = ["host", "open_seq"]
        more = held.groupBy(*key).agg(F.count_if(F.col("role") == "context").alias("_all"))
        less = capped.groupBy(*key).agg(F.count_if(F.col("role") == "context").alias("_kept"))
        cut = more.join(less, key, "left").select(*key, (F.col("_all") > F.coalesce("_kept", F.lit(0))).alias("truncated"))
        known = stored(begun.unionByName(capped.join(cut, key).select(*begun.columns)), "known")
        self._closing(spark, batch, closed, known.join(closed.select(*key), key, "left_semi"), now)

        still = judged.where(~is_closed).select(*key)
        kept = matches.join(still, "host").where(F.col("seq") >= F.col("open_seq")).select("host", "seq", "t")
        waiting = self._recent(lines, now).join(held.select("host", "seq"), ["host", "seq"], "left_anti")
        going = known.join(still, key, "left_semi")
        for name, df in (("lines", waiting), ("matches", kept), ("ends", now), ("open", going)):
            df.write.mode("overwrite").parquet(self._path(batch, name))
        if batch > 1:
            self._forget(spark, batch - 2)

    def _unused(self, spark: SparkSession) -> None:
        """Refuse to begin anew where later batches have ended: they are another checkpoint's, and would be read with this one's."""
        ended = spark._jvm.org.apache.hadoop.fs.Path(f"{self.output}/{MARKERS}/batch=*")
        found = ended.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(ended) or ()
        if any(status.getPath().getName() != "batch=0" for status in found):
            raise ValueError(f"{self.output} holds batches of another checkpoint: go on from that one, or begin with new folders")

    def _in_order(self, rows: DataFrame, ends: DataFrame) -> DataFrame:
        """host, seq, ts, line: as they come, or, for lines without numbers, numbered on from each source's last, with the
        time `at` where they have one, else the time they begin with, else that of their file."""
        if "seq" in rows.columns:
            return rows.select("host", "seq", "ts", "line")
        numbered = number_rows(rows.drop("ts"), ["host"], ["changed", "file", "block", "place", "piece"])
        if "at" in rows.columns:
            timed = numbered.withColumn("ts", F.col("at"))
        else:
            timed = stamped(numbered).withColumn("ts", F.coalesce("ts", "changed"))
        before = ends.select("host", F.col("end_seq").alias("_before"))
        return timed.join(before, "host", "left").select("host", (F.col("seq") + F.coalesce("_before", F.lit(0))).alias("seq"), "ts", "line")

    def _closing(self, spark: SparkSession, batch: int, closed: DataFrame, lines: DataFrame, now: DataFrame) -> None:
        """Write the captures that this batch closes: what is known of them, their text, and their requests."""
        key, params = ["host", "open_seq"], self.params
        lines = stored(lines, "closing")
        texts = f"{self.output}/texts/batch={batch}"
        told = capture_summary(lines, now.select("host", "end_t"), params).drop("end_reason", "until", "open_t", "n_matches")
        told = told.join(closed.select(*key, "open_t", "until", "n_matches", "last_seq", "last_t", "limit_seq", "end_reason"), key)
        told = told.join(always_notify_rollup(lines), key)
        told = told.join(lines.groupBy(*key).agg(F.bool_or("truncated").alias("context_truncated")), key)
        named = stored(capture_name(told, texts), "named")
        named.write.mode("overwrite").parquet(f"{self.output}/closed/batch={batch}")
        none = spark.createDataFrame([], "host string, open_seq bigint, held_by_seq bigint, n bigint")
        at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        stamp = spark.range(1).select(at.alias("at")).first()["at"]
        rendered = stored(render_capture(named, lines, none, params, stamp, stamp), "rendered")
        write_rendered(rendered, named, texts, "overwrite")
        if self.requests is None:
            return
        if self.requests.model and not self.requests.events:
            # who is told what waits for the model's answer: see answered()
            around = excerpt_around_match(place_rows(rendered, lines, self.size), self.requests.excerpt_bytes)
            asked = model_request(named.join(around, key), self.requests, self.salt)
            asked.write.mode("overwrite").parquet(f"{self.output}/model_requests/batch={batch}")
            return
        routed = stored(route_capture(named.withColumn("post_failed", F.lit(False)), self.requests), "routed")
        push_request(routed, self.requests).write.mode("overwrite").parquet(f"{self.output}/pushes/batch={batch}")
        if self.requests.events:
            placed = place_rows(rendered, lines, self.size)
            with_text = routed.join(excerpt_json_capped(placed), key, "left")
            event_payload(with_text, self.requests, stamp).write.mode("overwrite").parquet(f"{self.output}/events/batch={batch}")

    def _recent(self, lines: DataFrame, ends: DataFrame) -> DataFrame:
        """Lines a coming match can still reach: by time, and by the bytes of context allowed."""
        timed = lines.join(ends.select("host", F.col("end_t").alias("_end")), "host").where(
            F.col("t") >= F.col("_end") - self.params.window_us
        ).drop("_end")
        return newest_bytes(timed, self.params.context_bytes, self.size)

    def _path(self, batch: int, name: str) -> str:
        return f"{self.state}/{batch}/{name}"

    def _state(self, spark: SparkSession, batch: int, name: str, schema: str) -> DataFrame:
        if batch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self._path(batch - 1, name))

    def _watermark(self, ends: DataFrame, ticked: int | None) -> int | None:
        """The time no line may still be older than, in microseconds: by the newest line of any source, or by the clock."""
        if self.delay is None:
            return None
        times = [t for t in (ends.agg(F.max("end_t").alias("t")).first()["t"], ticked) if t is not None]
        return max(times) - self.delay * 1_000_000 if times else None

    def _closed(self, watermark: int | None) -> Column:
        """A capture ends when a later line came, when it is full, or when the watermark passes its end.
        Only a source's last capture can be open: any other has a later line."""
        closed = (F.col("end_t") > F.col("until")) | F.coalesce(F.col("full"), F.lit(False))
        return closed if watermark is None else closed | (F.col("until") < watermark)

    def _reason(self) -> Column:
        longest = F.lit(bool(self.params.longest_us)) & (F.col("until") == F.col("open_t") + self.params.longest_us)
        return F.when(F.col("full"), "line_cap").when(longest, "time_max").otherwise("time")

    def _forget(self, spark: SparkSession, batch: int) -> None:
        """Drop state that no rerun can ask for any more."""
        _remove(spark, f"{self.state}/{batch}")

    def start(
        self, lines: DataFrame, checkpoint: str, available_now: bool = False, seconds: int = 10, clock: bool | None = None
    ) -> StreamingQuery:
        """Run over a streaming table of lines (host, seq, ts, line, or what stream_text_lines gives); stops by itself
        with available_now. Without it, and with a delay, a clock runs along with the lines, so that captures
        are closed while all sources are quiet.

        A checkpoint is with or without a clock from its first run on. One that first catches up with available_now and then
        goes on with the clock takes clock=True in both: with available_now the clock stands still and closes nothing."""
        self.session = lines.sparkSession
        if self.unique is not None and "seq" in lines.columns:
            # a file that comes twice within that time is no late lines
            lines = lines.withWatermark("ts", f"{self.unique} seconds").dropDuplicatesWithinWatermark(["host", "seq"])
        if clock is None:
            clock = self.delay is not None and not available_now
        if clock:
            lines = self._with_clock(lines, ticks=not available_now)
        if clock and available_now:
            # else the clock's source, which has no end, makes all that is there one batch, however many files a batch may read
            self.session.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
        writer = lines.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
        return writer.start()

    def _with_clock(self, lines: DataFrame, ticks: bool = True) -> DataFrame:
        """The lines, and rows without a source that tell the time once a second (without ticks: none of them)."""
        clock = self.session.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.lit(ticks))
        if "ts" not in lines.columns:
            lines = lines.withColumn("ts", F.lit(None).cast("timestamp"))
        row = [F.col("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema]
        return lines.unionByName(clock.select(*row))


def committed(spark: SparkSession, output: str, table: str) -> DataFrame:
    """A table of a stream's output (lines, closed, texts, late, pushes, events, model_requests), of ended batches alone, with `batch`."""
    ended = spark.read.schema("id bigint, batch int").parquet(f"{output}/{MARKERS}").select("batch").distinct()
    return spark.read.parquet(f"{output}/{table}").join(ended, "batch", "left_semi")


def captured_stream_lines(spark: SparkSession, output: str) -> DataFrame:
    """All lines a stream has captured so far."""
    return committed(spark, output, "lines").drop("batch")


def late_lines(spark: SparkSession, stream: CaptureStream) -> DataFrame:
    """The lines that came too late to be read in order, with the batch they came in."""
    return committed(spark, stream.output, "late")


def closed_captures(spark: SparkSession, output: str) -> DataFrame:
    return committed(spark, output, "closed").drop("batch")


def outbox(spark: SparkSession, output: str, kind: str) -> DataFrame:
    """The pushes, events or model requests of all captures closed so far."""
    return committed(spark, output, kind).drop("batch")


def answered(spark: SparkSession, output: str, replies: DataFrame, params: RequestParams) -> DataFrame:
    """The pushes of closed captures that a model was asked about, given its replies: host, open_seq, reply (null or unusable: the
    capture is pushed as it is)."""
    said = parse_verdict(replies.select("host", "open_seq", "reply")).select(
        "host", "open_seq", F.col("title").alias("verdict_title"), F.col("summary").alias("verdict_summary"),
        F.col("notify").alias("verdict_notify"), F.col("error").alias("verdict_error"),
    )
    return push_request(route_capture(closed_captures(spark, output).join(said, ["host", "open_seq"]), params), params)


def posted(spark: SparkSession, output: str, results: DataFrame, params: RequestParams) -> DataFrame:
    """The pushes that posts of events call for, given how these went: host, open_seq, post_failed."""
    rows = closed_captures(spark, output).join(results.select("host", "open_seq", "post_failed"), ["host", "open_seq"])
    return push_request(route_capture(rows, params), params)
