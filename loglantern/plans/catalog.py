"""The registered queries: every operator over whole benchmark tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alert_body, alert_title, flatten_text, note_text, slugify, strip_ansi
from ..operators import captures as cap
from ..operators import context as ctx
from ..operators import excerpts, many_patterns, matching, rendering, requests, retention
from ..params import RequestParams
from ..sources import journal, lines, patterns
from ..sources.tables import (
    ALWAYS, DOC_PATTERNS, OWN, PARAMS, WATCH, doc_lines, labelled_lines, log_lines, once, raw_lines, table,
)
from ..streaming import store
from ..streaming.batches import CaptureStream, answered, captured_stream_lines, closed_captures, fixed, late_lines, outbox
from .scratch import scratch_path

NOW = "2024-02-10T00:00:00"
ROOT = "/captures"
SECOND_WATCH = matching.PatternSet.of(texts=["click user 1", "purchase user 2"])
EXCERPT_BYTES = 1100
SMALL_BYTES = 700
SALT = "fixed for repeatable checks"


# --- stages shared by several queries, each built once per session ---

def matches(spark, sf):
    return cap.match_rows(labelled_lines(spark, sf))


def captures(spark, sf):
    return once(spark, sf, "captures", lambda: cap.find_captures(matches(spark, sf), PARAMS))


def held(spark, sf):
    return once(spark, sf, "held", lambda: cap.capture_lines(labelled_lines(spark, sf), captures(spark, sf), PARAMS))


def summary(spark, sf):
    return once(
        spark, sf, "summary",
        lambda: cap.capture_summary(held(spark, sf), cap.source_ends(labelled_lines(spark, sf)), PARAMS),
    )


def spans(spark, sf):
    return once(spark, sf, "spans", lambda: ctx.overlapping_context(held(spark, sf), captures(spark, sf), PARAMS))


def capped(spark, sf):
    return once(spark, sf, "capped", lambda: ctx.context_windows(held(spark, sf), PARAMS))


def with_reusable(summaries: DataFrame) -> DataFrame:
    """Every fifth capture by its opener counts as not saved."""
    return summaries.withColumn("reusable", F.col("open_seq") % 5 != 0)


def ranges(spark, sf):
    return once(
        spark, sf, "ranges",
        lambda: ctx.held_ranges(capped(spark, sf), with_reusable(summary(spark, sf))),
    )


def named(spark, sf):
    def build():
        rows = with_reusable(summary(spark, sf)).join(
            capped(spark, sf).select("host", "open_seq", "context_truncated"), ["host", "open_seq"]
        )
        return rendering.capture_name(rows, ROOT)

    return once(spark, sf, "named", build)


def rendered(spark, sf):
    def build():
        rng = ranges(spark, sf)
        return rendering.render_capture(
            named(spark, sf), ctx.written_lines(held(spark, sf), rng), ctx.left_out_counts(rng), PARAMS, NOW, NOW
        )

    return once(spark, sf, "rendered", build)


def placed(spark, sf):
    return once(spark, sf, "placed", lambda: excerpts.place_rows(rendered(spark, sf), held(spark, sf)))


def incidents(spark, sf):
    """Captures with what routing reads; the verdict and post status follow from the opener's number."""
    rows = named(spark, sf).join(cap.always_notify_rollup(held(spark, sf)), ["host", "open_seq"])
    n = F.col("open_seq")
    return rows.withColumns({
        "path": F.when(F.col("reusable"), F.col("path")),
        "verdict_title": F.concat(F.lit("title "), n.cast("string")),
        "verdict_summary": F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("summary of "), F.col("pattern"))),
        "verdict_notify": F.when(n % 7 != 0, n % 2 == 0),
        "verdict_error": F.when(n % 7 == 0, F.lit("no answer")),
        "post_failed": n % 3 == 0,
    })


MODES = {
    "events": RequestParams(events=True),
    "plain": RequestParams(),
    "quiet": RequestParams(notify=False),
    "model": RequestParams(model=True, notes="a test\n host"),
}


# --- sources ---

def read_log_lines(spark, sf):
    odd = F.when(F.col("event_id") % 11 == 0, F.lit(" \t ")).when(
        F.col("event_id") % 7 == 0, F.concat("line", F.lit("\rx"))
    ).otherwise(F.col("line"))
    path = scratch_path(spark, "log_text")
    source = log_lines(spark, sf)
    source.repartitionByRange("host", "seq").sortWithinPartitions("host", "seq").select("host", odd.alias("line")).write.partitionBy("host").text(path, lineSep="\n")
    host = F.regexp_extract(F.col("_metadata.file_path"), "host=([^/]+)/", 1)
    return lines.read_log_lines(spark, path, host).select("host", "seq", "line")


def number_lines(spark, sf):
    return log_lines(spark, sf).select("host", "seq", "event_id", "t", "line")


def tail_start(spark, sf):
    return lines.tail_start(log_lines(spark, sf), last=20).select("host", "seq", "line")


def entries(spark, sf):
    """Events as journal entries: some without host, identifier, pid, source time or message; some of two lines."""
    n = F.col("event_id")
    rows = raw_lines(spark, sf)
    return rows.select(
        n.cast("string").alias("cursor"),
        F.col("t").alias("stored_us"),
        F.when(n % 3 == 0, F.col("t") - 1_500_000).alias("source_us"),
        F.when(n % 13 != 0, F.col("host")).alias("host"),
        F.when(n % 5 != 0, F.col("ident")).alias("ident"),
        F.when(n % 10 != 0, F.lit("comm")).alias("comm"),
        F.when(n % 4 != 0, F.col("pid")).alias("pid"),
        F.when(n % 8 != 0, F.lit("7")).alias("syslog_pid"),
        F.when(n % 17 != 0, F.when(n % 6 == 0, F.concat("message", F.lit("\n\nsecond "), "pid")).otherwise(F.col("message"))).alias("message"),
    )


def journal_to_lines(spark, sf):
    rows = journal.journal_to_lines(entries(spark, sf))
    return rows.select("cursor", F.col("part").cast("long").alias("part"), "line")


def read_journal_export(spark, sf):
    def field(name, column):
        return F.coalesce(F.concat(F.lit(name + "="), F.col(column).cast("string"), F.lit("\n")), F.lit(""))

    length = F.octet_length("message")
    binary = F.concat(F.lit("MESSAGE\n"), F.char(length), F.lit("\0" * 7), F.col("message"), F.lit("\n"))
    text = F.concat(F.lit("MESSAGE="), F.col("message"), F.lit("\n"))
    message = F.coalesce(F.when(F.col("message").contains("\n"), binary).otherwise(text), F.lit(""))
    record = F.concat(
        F.when(F.col("cursor").cast("long") % 19 != 0, field("__CURSOR", "cursor")).otherwise(""),
        field("__REALTIME_TIMESTAMP", "stored_us"), field("_SOURCE_REALTIME_TIMESTAMP", "source_us"), F.lit("_UID=0\n"),
        field("_HOSTNAME", "host"), field("SYSLOG_IDENTIFIER", "ident"), field("_COMM", "comm"), field("_PID", "pid"), message,
    )
    path = scratch_path(spark, "export")
    entries(spark, sf).repartition(8).select(record.alias("value")).write.text(path, lineSep="\n")
    found = journal.read_journal_export(spark, path)
    return found.select("cursor", "stored_us", "source_us", "host", "ident", "comm", "pid", "message")


def line_time(spark, sf):
    read = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 5).cast("int"))
    return raw_lines(spark, sf).select("event_id", F.unix_micros(lines.line_time(F.col("ts"), read)).alias("line_us"))


def numbered_entries(spark, sf):
    def build():
        rows = raw_lines(spark, sf).select(
            F.lit("journal").alias("host"), F.col("event_id").cast("string").alias("cursor"), "event_id", "line",
            (F.call_function("div", F.col("t"), F.lit(1_000_000).cast("long")) - F.when(F.col("event_id") % 9 == 0, 900).otherwise(0)).alias("stored"),
        )
        return lines.number_lines(rows, ["event_id"])

    return once(spark, sf, "numbered_entries", build)


def resume_slice(spark, sf):
    """Three resumes near the middle of the journal: the saved entry found, lost, and too old."""
    rows = numbered_entries(spark, sf)
    ends = rows.agg(F.min("stored").alias("low"), F.max("stored").alias("high")).first()
    middle = (ends["low"] + ends["high"]) // 2
    saved = rows.where(F.col("stored") <= middle).agg(F.max_by("cursor", "seq").alias("cursor")).first()["cursor"]
    cases = {
        "found": (journal.Position(saved, middle), middle + 3600),
        "lost": (journal.Position("gone", middle), middle + 3600),
        "old": (journal.Position(saved, middle), ends["high"]),
    }
    parts = [
        journal.resume_slice(rows, position, now, 36000, 86400, any_cursor=True).select(
            F.lit(name).alias("case"), "cursor", "role", F.col("time").cast("long").alias("time")
        )
        for name, (position, now) in cases.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def resume_by_host(spark, sf):
    """Every host resumed by its own position: found, lost, too old, and none."""
    rows = log_lines(spark, sf).select("host", "seq", F.col("event_id").cast("string").alias("cursor"), F.call_function("div", F.col("t"), F.lit(1_000_000).cast("long")).alias("stored"))
    ends = rows.agg(F.min("stored").alias("low"), F.max("stored").alias("high")).first()
    middle = (ends["low"] + ends["high"]) // 2
    saved = journal.position_of(rows.where(F.col("stored") <= middle))
    number = F.substr("host", F.lit(2)).cast("int")
    positions = saved.select(
        "host", F.when(number % 4 == 1, F.lit("gone")).otherwise(F.col("cursor")).alias("cursor"),
        F.when(number % 4 == 2, F.col("time") - 10 * 86400).otherwise(F.col("time")).alias("time"),
    ).where(number % 4 != 3)
    found = journal.resume_by_host(rows, positions, middle + 3600, 36000, 86400)
    return found.select("host", "seq", "role", F.col("time").cast("long").alias("time"))


def text_captures(spark, sf):
    """From text files to captures: lines written as text, read, numbered, timed by their stamps, labelled and cut."""
    path = scratch_path(spark, "text_log")
    log_lines(spark, sf).repartitionByRange("host", "seq").sortWithinPartitions("host", "seq").select("host", "line").write.partitionBy("host").text(path, lineSep="\n")
    host = F.regexp_extract(F.col("_metadata.file_path"), "host=([^/]+)/", 1)
    labelled = matching.label_lines(lines.read_log(spark, path, host), WATCH, ALWAYS, OWN)
    return cap.find_captures(cap.match_rows(labelled), PARAMS)


def export_record():
    """An event of raw_lines, with its cursor, as an export record."""
    field = lambda name, column: F.concat(F.lit(name + "="), F.col(column).cast("string"), F.lit("\n"))
    return F.concat(
        field("__CURSOR", "cursor"), field("__REALTIME_TIMESTAMP", "t"), field("_HOSTNAME", "host"),
        field("SYSLOG_IDENTIFIER", "ident"), field("_PID", "pid"), field("MESSAGE", "message"),
    )


def journal_captures(spark, sf):
    """From export files to captures."""
    path = scratch_path(spark, "export_log")
    rows = raw_lines(spark, sf).withColumn("cursor", F.format_string("%012d", "event_id"))
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(export_record().alias("value")).write.text(path, lineSep="\n")
    entries = journal.read_journal_export(spark, path).drop("file", "place")
    labelled = matching.label_lines(journal.journal_log(entries), WATCH, ALWAYS, OWN)
    return cap.find_captures(cap.match_rows(labelled), PARAMS)


# --- patterns ---

def load_patterns(spark, sf):
    path = scratch_path(spark, "patterns")
    table(spark, sf, "events").select(F.concat(F.lit("  "), "props", F.lit(" ")).alias("value")).write.text(path)
    return patterns.load_patterns(spark, [path]).select("kind", "pattern", "needle", F.col("rank").cast("long").alias("rank"))


def matches_query(spark, sf):
    rows = doc_lines(spark, sf)
    return rows.where(matching.matches(F.col("line"), DOC_PATTERNS, OWN)).select("doc_id", "line_no")


def first_match(spark, sf):
    label = matching.first_match(F.col("line"), DOC_PATTERNS)
    return doc_lines(spark, sf).select("doc_id", "line_no", label.alias("label")).where(F.col("label").isNotNull())


def first_match_many(spark, sf):
    """Every line by half of all messages as substrings, besides some regular expressions and globs: thousands of patterns, which grow with the log and stay a table."""
    texts = raw_lines(spark, sf).where("event_id % 2 = 0").select(F.col("message").alias("text"))  # the pattern file
    watch = matching.PatternSet.of([rf"error user {u} .*\d" for u in range(1, 10)], ["sign?p user [2-4]5", "click*1}"])
    found = many_patterns.label_lines_indexed(log_lines(spark, sf), watch, ALWAYS, OWN, texts)
    return found.where(F.col("label").isNotNull()).select("host", "seq", "label", "always")


def pattern_versions_many(spark, sf):
    """A new version every 10 lines: 100 of them, each with a pattern of its own."""
    versions = [matching.PatternVersion(matching.PatternSet.of(texts=[f'"k": {n}']), 10 * n, 10 * n + 10, ALWAYS) for n in range(100)]
    found = many_patterns.label_lines_by_version(log_lines(spark, sf), versions, OWN)
    return found.where(F.col("label").isNotNull()).select("host", "seq", "label", "always")


def substring_predicate(spark, sf):
    return doc_lines(spark, sf).where(matching.substring_predicate(F.col("line"), "the ")).select("doc_id", "line_no")


def glob_predicate(spark, sf):
    return doc_lines(spark, sf).where(matching.glob_predicate(F.col("line"), "*q?e [!a-l]*")).select("doc_id", "line_no")


def regex_predicate(spark, sf):
    return doc_lines(spark, sf).where(matching.regex_predicate(F.col("line"), r"[a-z]{3}ation\.$")).select("doc_id", "line_no")


def is_own_line(spark, sf):
    tail = F.when(F.col("seq") % 3 == 0, F.regexp_replace("line", r"\A\S+ ", "")).otherwise(F.col("line"))
    quoted = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("saw "), tail)).otherwise(tail)
    rows = log_lines(spark, sf).withColumn("line", quoted)
    return rows.select("host", "seq", matching.is_own_line(F.col("line"), OWN).alias("own"))


def pattern_versions(spark, sf):
    versions = [
        matching.PatternVersion(WATCH, 0, 500, ALWAYS),
        matching.PatternVersion(SECOND_WATCH, 500),
    ]
    found = matching.label_lines_versioned(log_lines(spark, sf), versions, OWN)
    return found.where(F.col("label").isNotNull()).select("host", "seq", "label", "always")


def pattern_versions_by_time(spark, sf):
    """A reload at one moment, which is another line of each host."""
    ends = log_lines(spark, sf).agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    middle = (ends["low"] + ends["high"]) // 2
    versions = [matching.PatternVersion(WATCH, always=ALWAYS, to_t=middle), matching.PatternVersion(SECOND_WATCH, from_t=middle)]
    found = matching.label_lines_versioned(log_lines(spark, sf), versions, OWN)
    return found.where(F.col("label").isNotNull()).select("host", "seq", "label", "always")


def always_notify_match(spark, sf):
    rows = labelled_lines(spark, sf)
    return rows.where(F.col("always")).select("host", "seq", "label")


def text_column(spark, sf, column):
    return table(spark, sf, "conversations").select("conv_id", "turn", column.alias("text"))


def flatten(spark, sf):
    return text_column(spark, sf, flatten_text(F.regexp_replace("text", r"\. ", ".\r\n")))


def notes(spark, sf):
    return text_column(spark, sf, note_text(F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))))


def ansi(spark, sf):
    return text_column(spark, sf, strip_ansi(F.regexp_replace("text", "e", "\u001b[1;93me\u001b[0m")))


def slugs(spark, sf):
    return slugify(doc_lines(spark, sf), "line").select("doc_id", "line_no", "slug")


# --- captures ---

def capture_sessions(spark, sf):
    return cap.capture_sessions(matches(spark, sf), PARAMS)


def capture_sessions_capped(spark, sf):
    return cap.find_captures(matches(spark, sf), PARAMS)


def captured(spark, sf):
    """The whole path from labelled lines to captured lines, nothing reused."""
    return cap.captured_lines(labelled_lines(spark, sf), PARAMS)[1]


def capture_members(spark, sf):
    return cap.capture_members(captured(spark, sf)).select("host", "open_seq", "seq", "role", "line")


def owned_context(spark, sf):
    return captured(spark, sf).where(F.col("role") == "context").select("host", "open_seq", "seq", "line")


def overlapping_context(spark, sf):
    return ctx.overlapping_context(held(spark, sf), captures(spark, sf), PARAMS).drop("open_t")


def lookback_context(spark, sf):
    return ctx.lookback_context(held(spark, sf), spans(spark, sf)).select("host", "open_seq", "seq", "line")


def context_byte_cap(spark, sf):
    return ctx.context_windows(held(spark, sf), PARAMS).select(
        "host", "open_seq", "kept_first", "kept_lines", "context_truncated"
    )


def capped_context(spark, sf):
    rows = ctx.cap_context(held(spark, sf), PARAMS)
    return rows.where(F.col("role") == "context").select("host", "open_seq", "seq", "line")


def context_dedup(spark, sf):
    return ctx.context_dedup(held(spark, sf), ranges(spark, sf)).select("host", "open_seq", "seq", "line")


def left_out_counts(spark, sf):
    return ctx.left_out_counts(ranges(spark, sf))


def capture_summary(spark, sf):
    labelled = labelled_lines(spark, sf)
    rows = cap.capture_summary(captured(spark, sf), cap.source_ends(labelled), PARAMS)
    return rows.select(
        "capture_id", "host", "open_seq", "open_t", "until", "end_seq", "end_t", "pattern", "matched_line",
        "lines_after", "context_lines", "n_matches", "end_reason",
    )


def always_notify_rollup(spark, sf):
    return cap.always_notify_rollup(held(spark, sf))


def range_coalesce(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")).alias("host"),
        F.col("o_orderkey").alias("low"), (F.col("o_orderkey") + F.col("o_custkey") % 17).alias("high"),
    )
    return ctx.range_coalesce(rows)


def run_counters(spark, sf):
    return cap.run_counters(labelled_lines(spark, sf))


SMALL = 64  # lines of a bucket: captures, windows and runs then cross many buckets


def small_captures(spark, sf):
    return once(spark, sf, "small_captures", lambda: cap.find_captures(matches(spark, sf), PARAMS, SMALL))


def small_held(spark, sf):
    return once(spark, sf, "small_held", lambda: cap.capture_lines(labelled_lines(spark, sf), small_captures(spark, sf), PARAMS, SMALL))


def small_capped(spark, sf):
    def build():
        return ctx.context_windows(small_held(spark, sf), PARAMS, SMALL)

    return once(spark, sf, "small_capped", build)


def capture_sessions_split(spark, sf):
    return cap.find_captures(matches(spark, sf), PARAMS, SMALL)


def capture_members_split(spark, sf):
    return cap.capture_members(small_held(spark, sf)).select("host", "open_seq", "seq", "role", "line")


def context_byte_cap_split(spark, sf):
    return small_capped(spark, sf).select("host", "open_seq", "kept_first", "kept_lines", "context_truncated")


def left_out_counts_split(spark, sf):
    told = cap.capture_summary(small_held(spark, sf), cap.source_ends(labelled_lines(spark, sf)), PARAMS)
    return ctx.left_out_counts(ctx.held_ranges(small_capped(spark, sf), with_reusable(told), SMALL), SMALL)


# --- text of captures ---

def capture_name(spark, sf):
    return rendering.capture_name(summary(spark, sf), ROOT).select("host", "open_seq", "month", "name", "path")


def capture_index(spark, sf):
    return rendering.capture_index(named(spark, sf))


def render_capture(spark, sf):
    rng = ranges(spark, sf)
    rows = rendering.render_capture(
        named(spark, sf), ctx.written_lines(held(spark, sf), rng), ctx.left_out_counts(rng), PARAMS, NOW, NOW
    )
    return rows.select("host", "open_seq", F.col("part").cast("long").alias("part"), "pos", "text")


def append_analysis(spark, sf):
    told = incidents(spark, sf).select(
        "host", "open_seq", F.col("verdict_title").alias("title"), F.concat_ws("\n", "verdict_summary", "matched_line").alias("summary"),
        F.col("verdict_notify").alias("notify"), F.col("verdict_error").alias("error"),
    )
    rows = rendering.append_analysis(rendered(spark, sf), told)
    return rows.where(F.col("part") == rendering.ADDED).select("host", "open_seq", "pos", "text")


def excerpt_marks(spark, sf):
    return excerpts.excerpt_marks(excerpts.place_rows(rendered(spark, sf), held(spark, sf)))


def excerpt_around_match(spark, sf):
    return excerpts.excerpt_around_match(placed(spark, sf), EXCERPT_BYTES)


def excerpt_head_tail(spark, sf):
    return excerpts.excerpt_head_tail(placed(spark, sf), SMALL_BYTES)


def excerpt_json_capped(spark, sf):
    return excerpts.excerpt_json_capped(placed(spark, sf), EXCERPT_BYTES)


# --- requests ---

def titles(spark, sf):
    rows = doc_lines(spark, sf)
    return rows.select("doc_id", "line_no", alert_title(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("line")).alias("title"))


def bodies(spark, sf):
    where = F.concat(F.lit("/captures/"), F.col("doc_id").cast("string"), F.lit("/é.log"))
    return table(spark, sf, "documents").select("doc_id", alert_body(F.col("text"), where).alias("body"))


def route_capture(spark, sf):
    rows = incidents(spark, sf)
    parts = [
        requests.route_capture(rows, params).select(
            F.lit(mode).alias("mode"), "host", "open_seq", "push", "title", "body_text", "model_called", "to_phone"
        )
        for mode, params in MODES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def event_payload(spark, sf):
    rows = incidents(spark, sf).join(excerpts.excerpt_json_capped(placed(spark, sf)), ["host", "open_seq"])
    found = requests.event_payload(requests.route_capture(rows, MODES["events"]), MODES["events"], NOW)
    fields = "source string, version string, host string, pattern string, title string, body string, push boolean, always_notify boolean, excerpt string, path string, time string"
    read = F.from_json("event", fields)  # read back from the JSON
    return found.select("host", "open_seq", *(read[f].alias(f) for f in ("source", "version", "pattern", "title", "body", "push", "always_notify", "excerpt", "path", "time")))


def model_request(spark, sf):
    rows = incidents(spark, sf).join(excerpts.excerpt_around_match(placed(spark, sf), EXCERPT_BYTES), ["host", "open_seq"])
    found = requests.model_request(rows, MODES["model"], SALT)
    read = F.from_json("request", "model string, temperature int, messages array<struct<role: string, content: string>>")
    return found.select(
        "host", "open_seq", read["model"].alias("model"), read["temperature"].alias("temperature"),
        F.array_join(read["messages"]["role"], " ").alias("roles"), F.element_at(read["messages"]["content"], 2).alias("content"),
    )


def push_request(spark, sf):
    return requests.push_request(requests.route_capture(incidents(spark, sf), MODES["model"]), MODES["model"])


def replies(spark, sf):
    """Conversation turns as model replies: bare, fenced, inside other text, and broken in several ways."""
    n = (F.col("conv_id") * 7 + F.col("turn")) % 13
    notify = (F.col("conv_id") + F.col("turn")) % 2 == 0
    good = F.to_json(F.struct(F.concat(F.lit("On\n"), F.left("text", F.lit(250))).alias("title"), F.col("text").alias("summary"), notify.alias("notify")))
    forms = [
        good, F.concat(F.lit("```json\n"), good, F.lit("\n```")), F.concat(F.lit("Here it is: "), good, F.lit(" Done.")), F.col("text"),
        F.concat(F.lit("["), good, F.lit("]")), F.lit('{"title": "t", "summary": "s", "notify": "true"}'),
        F.lit('{"title": "  ", "summary": null, "notify": true}'), F.lit('{"title": 5, "notify": false, "more": [1]}'),
        F.concat(good, F.lit(' and {"b": 1}')), F.concat(good, F.lit(" junk }")),
        F.lit('{"title": "first", "title": "last", "notify": true, "notify": false}'), F.lit('{"title": "t", "n": NaN, "notify": true}'),
        F.lit('{"title": "t", "summary": 12345678901234567890123456789012345678901234, "notify": true}'),
    ]
    reply = F.element_at(F.array(*forms), (n + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply"))


def parse_verdict(spark, sf):
    return requests.parse_verdict(replies(spark, sf)).drop("reply")


# --- retention ---

def write_captures(spark, sf):
    path = scratch_path(spark, "store")
    rows = held(spark, sf).withColumn("month", rendering.month_of(F.col("open_t")))
    retention.write_captures(rows.select("month", "host", "open_seq", "seq", "role", "line"), path)
    return spark.read.parquet(path).select(F.col("month").cast("string").alias("month"), "host", "open_seq", "seq", "role", "line")


def write_rendered(spark, sf):
    path = scratch_path(spark, "texts")
    retention.write_rendered(rendered(spark, sf), named(spark, sf), path)
    back = retention.read_rendered(spark, path)
    return back.select("month", "host", "name", F.col("part").cast("long").alias("part"), "pos", "text")


def capture_paths(spark, sf):
    """Every path of the index, with the rows that are found in the folder it names."""
    path = scratch_path(spark, "texts")
    here = rendering.capture_name(named(spark, sf).drop("slug", "month", "name", "path"), path)
    retention.write_rendered(rendered(spark, sf), here, path)
    entries = rendering.capture_index(here).select("host", "open_seq", F.element_at(F.split("entry", rendering.INDEX_TO), -1).alias("path"))
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    found = spark.read.parquet(path).select(F.concat(F.regexp_replace(folder, "^file:/*", "/"), F.lit("#"), "host", F.lit("/"), "name").alias("path"))
    found = found.groupBy("path").agg(F.count("*").alias("rows"))
    rows = entries.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).join(found, "path", "left")
    return rows.select("host", "open_seq", F.coalesce("rows", F.lit(0)).alias("rows"))


def month_texts(spark, sf):
    """Orders as text, one folder per month."""
    path = scratch_path(spark, "months")
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("value"),
    )
    rows.write.partitionBy("month").text(path, lineSep="\n")
    return path


def partition_usage(spark, sf):
    return retention.partition_usage(spark, month_texts(spark, sf)).select("month", "bytes")


def usage(spark, sf):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-28"))
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum(F.col("o_custkey") + 1000).alias("bytes"), F.max(F.to_timestamp(stamp)).alias("newest"), F.count("*").alias("entries")
    ).withColumn("root", F.lit(ROOT))


def retention_plan(spark, sf):
    return retention.retention_plan(usage(spark, sf), "1999-03-15", 12, 36).select("month", "bytes", "action")


def purge_plan(spark, sf):
    plan = retention.purge_plan(usage(spark, sf), 500_000, "1999-03-15", ("1995-02",))
    return plan.select("month", "bytes")


def order_months(spark, sf):
    path = scratch_path(spark, "compacted")
    rows = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_custkey")
    rows.repartition(4).write.partitionBy("month").parquet(path)
    return path


def month_rows(spark, path):
    """The rows of a store of months; with each, its month's number of files and whether all are compacted."""
    month = F.regexp_extract(F.col("_metadata.file_path"), "/month=([^/]+)/[^/]+$", 1)
    rows = spark.read.parquet(path).select(month.alias("month"), "o_orderkey", "o_custkey")
    return rows.join(retention.partition_usage(spark, path).select("month", "compacted", F.col("entries").alias("files")), "month")


def compact_month(spark, sf):
    """All months compacted."""
    path = order_months(spark, sf)
    months = [r["month"] for r in retention.partition_usage(spark, path).select("month").collect()]
    retention.compact_months(spark, path, months)
    return month_rows(spark, path)


def apply_plan(spark, sf):
    """The plan carried out: old months gone, middle ones compacted, new ones as they were; then once more, which changes nothing."""
    path = order_months(spark, sf)
    for _ in range(2):
        plan = retention.retention_plan(retention.partition_usage(spark, path), "1999-03-15", 12, 36)
        retention.apply_plan(spark, path, plan)
    return month_rows(spark, path).drop("files")


# --- streams ---

def feed(spark, sf, slices, delay=None, params=None, unique=None, clock=None):
    """Run a capture stream over the given time slices of the log, one at a time: every slice
    lands as new files, and a new query resumes from the checkpoint. With clock, it can go on with one."""
    base = scratch_path(spark, "stream")
    rows = log_lines(spark, sf).select("host", "seq", "ts", "t", "line")
    ends = rows.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    step = (ends["high"] - ends["low"]) // 3 + 1
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH, ALWAYS), PARAMS, OWN, delay, requests=params, unique=unique, salt=SALT)
    for part in slices:
        inside = (F.col("t") >= ends["low"] + part * step) & (F.col("t") < ends["low"] + (part + 1) * step)
        rows.where(inside).drop("t").write.mode("append").parquet(f"{base}/in")
        source = lines.stream_log_lines(spark, f"{base}/in")
        stream.start(source, f"{base}/checkpoint", available_now=True, clock=clock).awaitTermination()
    return stream


_plain_feeds: dict[tuple[str, str], CaptureStream] = {}


def plain_feed(spark, sf):
    """The stream over three slices without more, run once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _plain_feeds:
        _plain_feeds[key] = feed(spark, sf, (0, 1, 2))
    return _plain_feeds[key]


def ticked(progress):
    """Whether the clock, which begins at 0, has ticked in a batch: lines alone may come before it has."""
    return any(s.description.startswith("RateStream") and s.endOffset not in (s.startOffset, "0") for s in progress.sources)


def until_tick(stream, source, checkpoint):
    """Run a stream by its trigger until a batch in which the clock has ticked has ended."""
    run = stream.start(source, checkpoint, seconds=1)
    while run.isActive and not any(ticked(p) for p in run.recentProgress):
        run.awaitTermination(1)
    run.stop()
    if run.exception():
        raise run.exception()
    return stream


def stream_captures(spark, sf):
    stream = plain_feed(spark, sf)
    return captured_stream_lines(spark, stream.output).select("host", "open_seq", "seq", "role", "line")


def quiet_close(spark, sf):
    stream = feed(spark, sf, (0, 1, 2), delay=600)
    return closed_captures(spark, stream.output).select("host", "open_seq", "until", "n_matches", "end_reason")


def quiet_close_by_clock(spark, sf):
    """After the last line only the clock ticks, years on: every capture closes."""
    stream = feed(spark, sf, (0, 1, 2), delay=600, clock=True)
    base = stream.output.removesuffix("/out")
    until_tick(stream, lines.stream_log_lines(spark, f"{base}/in"), f"{base}/checkpoint")
    return closed_captures(spark, stream.output).select("host", "open_seq", "until", "n_matches", "end_reason")


def quiet_close_text(spark, sf):
    """Text files without any further one: the clock closes their captures."""
    base = scratch_path(spark, "quiet_text")
    rows = log_lines(spark, sf).repartitionByRange("host", "seq").sortWithinPartitions("host", "seq")
    rows.select("host", "line").write.partitionBy("host").text(f"{base}/in", lineSep="\n")
    one_time(spark, f"{base}/in", set())
    host = F.regexp_extract(F.col("_metadata.file_path"), "host=([^/]+)/", 1)
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH, ALWAYS), PARAMS, OWN, 600)
    until_tick(stream, lines.stream_text_lines(spark, f"{base}/in", host), f"{base}/checkpoint")
    until_tick(stream, lines.stream_text_lines(spark, f"{base}/in", host), f"{base}/checkpoint")
    return closed_captures(spark, stream.output).select("host", "open_seq", "until", "n_matches", "end_reason")


def stream_redelivered(spark, sf):
    """The middle third comes twice within the time in which lines are known again: the same captures, and no late lines."""
    stream = feed(spark, sf, (0, 1, 1, 2), unique=60 * 86400)
    late = late_lines(spark, stream).select("host", F.lit(-1).cast("long").alias("open_seq"), "seq", F.lit("late").alias("role"), "line")
    return captured_stream_lines(spark, stream.output).select("host", "open_seq", "seq", "role", "line").unionByName(late)


def stream_journal_captures(spark, sf):
    """Export files as a stream, in three slices, from entries to captured lines."""
    base = scratch_path(spark, "journal_stream")
    rows = raw_lines(spark, sf).withColumn("cursor", F.format_string("%012d", "event_id"))
    ends = rows.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    step = (ends["high"] - ends["low"]) // 3 + 1
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH, ALWAYS), PARAMS, OWN)
    for part in range(3):
        own = rows.where((F.col("t") >= ends["low"] + part * step) & (F.col("t") < ends["low"] + (part + 1) * step))
        own = own.repartitionByRange(4, "t", "event_id").sortWithinPartitions("t", "event_id")
        own.select(export_record().alias("value")).write.mode("append").text(f"{base}/in", lineSep="\n")
        entries = journal.stream_journal_export(spark, f"{base}/in", every=20_000)
        stream.start(journal.stream_journal_lines(entries), f"{base}/checkpoint", available_now=True).awaitTermination()
    return captured_stream_lines(spark, stream.output).select("host", "open_seq", "seq", "role", "line")


def stream_model_requests(spark, sf):
    """What a stream asks a model about each closed capture, and the pushes that its answers lead to: of three, one is to be
    told, one not, and one is no answer."""
    asks = RequestParams(model=True, notes="a test host")
    stream = feed(spark, sf, (0, 1, 2), params=asks)
    requests_ = outbox(spark, stream.output, "model_requests")
    content = F.element_at(F.from_json("request", "messages array<struct<role: string, content: string>>")["messages"]["content"], 2)
    notify = F.when(F.col("open_seq") % 3 == 0, "true").when(F.col("open_seq") % 3 == 1, "false").otherwise("5")
    reply = F.concat(F.lit('{"title": "capture '), F.col("open_seq").cast("string"), F.lit('", "summary": "said", "notify": '), notify, F.lit("}"))
    pushes = answered(spark, stream.output, requests_.select("host", "open_seq", reply.alias("reply")), asks)
    told = pushes.select("host", "open_seq", "title", F.substring_index("body", "\n", 1).alias("body"))
    asked = requests_.select(
        "host", "open_seq", F.regexp_extract(content, r"Matched pattern: (.*)\n", 1).alias("pattern"),
        F.regexp_extract(content, r"Matched line: (.*)\n", 1).alias("matched_line"), content.contains("Excerpt:\n-").alias("has_excerpt"),
    )
    return asked.join(told, ["host", "open_seq"], "left")


def stream_late_lines(spark, sf):
    """The middle third comes twice, and the first once more when all is over: those are late."""
    stream = feed(spark, sf, (0, 1, 1, 2, 0))
    return late_lines(spark, stream).select("host", "seq", "line", F.col("batch").cast("long").alias("batch"))


def stream_text_captures_by_host(spark, sf):
    """The text files of all sources as a stream: numbered, timed, cut, in three batches. A file's folder names its source;
    a slice of a source may be several files, of one time, in order of name."""
    base = scratch_path(spark, "text_stream")
    rows = log_lines(spark, sf)
    most = rows.agg(F.max("seq").alias("n")).first()["n"]
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH, ALWAYS), PARAMS, OWN, 10**9)
    host = F.regexp_extract(F.col("_metadata.file_path"), "host=([^/]+)/", 1)
    seen = set()
    for part in range(3):
        inside = (F.col("seq") > part * most // 3) & (F.col("seq") <= (part + 1) * most // 3)
        own = rows.where(inside).repartitionByRange("host", "seq").sortWithinPartitions("host", "seq")
        own.select("host", "line").write.mode("append").partitionBy("host").text(f"{base}/in", lineSep="\n")
        seen |= one_time(spark, f"{base}/in", seen)
        source = lines.stream_text_lines(spark, f"{base}/in", host)
        stream.start(source, f"{base}/checkpoint", available_now=True).awaitTermination()
    return captured_stream_lines(spark, stream.output).select("host", "open_seq", "seq", "role", "line")


def one_time(spark, path, seen):
    """Give the files of a folder that were not seen before the newest one's time, and name them: tasks end in any order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files, new = store.listFiles(folder, True), []
    while files.hasNext():
        file = files.next()
        if file.getPath().toString() not in seen:
            new.append(file)
    newest = max((file.getModificationTime() for file in new), default=0)
    for file in new:
        store.setTimes(file.getPath(), newest, -1)
    return {file.getPath().toString() for file in new}


def stream_outbox(spark, sf):
    """The pushes of all captures that a stream closes."""
    stream = feed(spark, sf, (0, 1, 2), params=RequestParams(events=True))
    closed = closed_captures(spark, stream.output).select("host", "open_seq", "pattern", "matched_line", "always_notify", "end_reason", "lines_after")
    events = outbox(spark, stream.output, "events")
    read = F.from_json("event", "push boolean, title string, path string, excerpt string")
    return closed.join(events.select("host", "open_seq", read.alias("e")), ["host", "open_seq"]).select(
        *closed.columns, "e.push", "e.title", F.col("e.path").contains("#").alias("has_path"), (F.length("e.excerpt") > 0).alias("has_excerpt")
    )


def stream_retention(spark, sf):
    """Body lines of the texts that a stream wrote, its sources' logs some months apart: after two batches months are compacted, after
    the third the oldest are deleted and others compacted again."""
    base = scratch_path(spark, "aged_stream")
    rows = log_lines(spark, sf).select("host", "seq", "ts", "t", "line")
    ends = rows.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    step = (ends["high"] - ends["low"]) // 3 + 1
    later = F.make_dt_interval(days=F.pmod(F.substring("host", 2, 9).cast("int"), F.lit(4)) * 31)
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH, ALWAYS), PARAMS, OWN)
    for part, delete_after in ((0, None), (1, 0), (2, 3)):
        inside = (F.col("t") >= ends["low"] + part * step) & (F.col("t") < ends["low"] + (part + 1) * step)
        own = rows.where(inside).withColumn("ts", F.col("ts") + later).drop("t")
        own.write.mode("append").parquet(f"{base}/in")
        stream.start(lines.stream_log_lines(spark, f"{base}/in"), f"{base}/checkpoint", available_now=True).awaitTermination()
        if delete_after is not None:
            plan = retention.retention_plan(store.stream_usage(spark, stream.output), "2024-04-20", 1, delete_after)
            store.apply_stream_plan(spark, stream.output, plan)
    compacted = store.stream_usage(spark, stream.output).select("month", "compacted")
    body = store.stream_texts(spark, stream.output).where(F.col("part") == rendering.BODY)
    return body.join(compacted, "month").select("month", "host", F.col("pos").alias("seq"), "text", "compacted")


def stream_state(spark, sf):
    """What a stream keeps after three batches: lines that a coming match can still reach, the matches of open captures, and each
    source's last line."""
    stream = plain_feed(spark, sf)
    kept = lambda name, seq: spark.read.parquet(f"{stream.state}/2/{name}").select(
        F.lit({"lines": "line", "matches": "match", "ends": "end"}[name]).alias("kind"), "host", F.col(seq).alias("seq")
    )
    return kept("lines", "seq").unionByName(kept("matches", "seq")).unionByName(kept("ends", "end_seq"))


def backlog_catch_up(spark, sf):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return lines.catch_up(log_lines(spark, sf), now, 5 * 86400).select("host", "seq", "line")


QUERIES = {
    "read_log_lines": read_log_lines, "number_lines": number_lines, "tail_start": tail_start,
    "read_journal_export": read_journal_export, "journal_to_lines": journal_to_lines, "resume_slice": resume_slice,
    "line_time": line_time, "load_patterns": load_patterns, "matches": matches_query, "first_match": first_match,
    "first_match_many": first_match_many, "pattern_versions_many": pattern_versions_many,
    "substring_predicate": substring_predicate, "glob_predicate": glob_predicate, "regex_predicate": regex_predicate,
    "is_own_line": is_own_line, "pattern_versions": pattern_versions, "pattern_versions_by_time": pattern_versions_by_time,
    "resume_by_host": resume_by_host, "text_captures": text_captures, "journal_captures": journal_captures, "always_notify_match": always_notify_match,
    "flatten_text": flatten, "note_text": notes, "strip_ansi": ansi, "slugify": slugs,
    "capture_sessions": capture_sessions, "capture_sessions_capped": capture_sessions_capped,
    "capture_sessions_split": capture_sessions_split, "capture_members_split": capture_members_split,
    "context_byte_cap_split": context_byte_cap_split, "left_out_counts_split": left_out_counts_split,
    "capture_members": capture_members, "owned_context": owned_context, "lookback_context": lookback_context,
    "overlapping_context": overlapping_context, "context_byte_cap": context_byte_cap, "capped_context": capped_context, "context_dedup": context_dedup,
    "left_out_counts": left_out_counts, "capture_summary": capture_summary, "always_notify_rollup": always_notify_rollup,
    "range_coalesce": range_coalesce, "run_counters": run_counters, "capture_name": capture_name,
    "capture_index": capture_index, "render_capture": render_capture, "append_analysis": append_analysis,
    "excerpt_marks": excerpt_marks, "excerpt_around_match": excerpt_around_match, "excerpt_head_tail": excerpt_head_tail,
    "excerpt_json_capped": excerpt_json_capped, "alert_title": titles, "alert_body": bodies, "route_capture": route_capture,
    "event_payload": event_payload, "model_request": model_request, "parse_verdict": parse_verdict,
    "push_request": push_request, "write_captures": write_captures, "write_rendered": write_rendered, "partition_usage": partition_usage,
    "retention_plan": retention_plan, "purge_plan": purge_plan, "compact_month": compact_month, "apply_plan": apply_plan, "capture_paths": capture_paths,
    "stream_captures": stream_captures, "stream_text_captures_by_host": stream_text_captures_by_host,
    "stream_outbox": stream_outbox,
    "stream_retention": stream_retention, "stream_state": stream_state, "quiet_close": quiet_close, "quiet_close_by_clock": quiet_close_by_clock, "stream_late_lines": stream_late_lines,
    "quiet_close_text": quiet_close_text, "stream_redelivered": stream_redelivered, "stream_journal_captures": stream_journal_captures,
    "stream_model_requests": stream_model_requests,
    "backlog_catch_up": backlog_catch_up,
}


def in_utc(query):
    """Run a query with times rendered in UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run
