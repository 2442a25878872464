"""Captures: from matches to sessions, and from sessions to the lines they hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..params import CaptureParams
from ..plans.ordered import BUCKET, bucket_of, neighbours
from ..plans.scratch import stored

#: Stretches of a source that one task joins.
GROUP = 64


def capture_id() -> Column:
    return F.concat_ws("-", "host", "open_seq")


def match_rows(labelled: DataFrame) -> DataFrame:
    """host, seq, t of the lines that matched: all that capture limits depend on."""
    return labelled.where(F.col("label").isNotNull()).select("host", "seq", "t")


def islands(matches: DataFrame, gap_us: int, gap_lines: int | None = None, size: int = BUCKET) -> DataFrame:
    """Add the start (island_seq, island_t) of the run of matches each match belongs to.
    A run ends at a gap longer than gap_us or, when given, gap_lines.

    Runs are found inside each bucket; one row per bucket then tells whether its first
    run goes on from the bucket before, and where that one began.
    """
    point = F.struct("seq", "t")

    def parted(later: Column, earlier: Column) -> Column:
        apart = earlier.isNull() | (later["t"] - earlier["t"] > gap_us)
        return apart if gap_lines is None else apart | (later["seq"] - earlier["seq"] > gap_lines)

    inside = Window.partitionBy("host", "bucket").orderBy("seq")
    prev = F.lag("point").over(inside)
    rows = matches.select("host", bucket_of(F.col("seq"), size).alias("bucket"), point.alias("point"), "seq").select(
        "*", F.when(prev.isNotNull() & parted(F.col("point"), prev), F.col("point")).alias("opens")
    )
    across = Window.partitionBy("host").orderBy("bucket")
    so_far = across.rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        rows.groupBy("host", "bucket")
        .agg(F.min("point").alias("first"), F.max("point").alias("last"), F.max("opens").alias("inner"))
        .select("*", F.when(parted(F.col("first"), F.lag("last").over(across)), F.col("first")).alias("fresh"))
        .select("*", F.last(F.coalesce("inner", "fresh"), ignorenulls=True).over(so_far).alias("ran"))
        .select("host", "bucket", F.coalesce("fresh", F.lag("ran").over(across)).alias("lead_in"))
    )
    latest = F.last("opens", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce("start", "lead_in")
    return (
        rows.select("host", "bucket", "point", latest.alias("start"))
        .join(edges, ["host", "bucket"])
        .select("host", F.col("point.seq").alias("seq"), F.col("point.t").alias("t"),
                start["seq"].alias("island_seq"), start["t"].alias("island_t"))
    )


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host", "open_seq", "open_t").agg(
        F.max("seq").alias("last_seq"), F.max("t").alias("last_t"), F.count("*").alias("n_matches")
    )


def capture_sessions(matches: DataFrame, params: CaptureParams, size: int = BUCKET) -> DataFrame:
    """Sessions bounded by time alone: a match more than capture_time after the last opens a new one."""
    rows = islands(matches, params.window_us, size=size)
    spans = _spans(rows.withColumnsRenamed({"island_seq": "open_seq", "island_t": "open_t"}))
    return spans.withColumn("until", F.col("last_t") + params.window_us)


class _Bucket:
    """The matches of one bucket in order, and for each the match that opens the next
    capture if it opened one itself (len: none of this bucket)."""

    def __init__(self, seq: np.ndarray, t: np.ndarray, params: CaptureParams):
        self.seq, self.t, self.params, n = seq, t, params, len(seq)
        quiet = np.flatnonzero(t[1:] - t[:-1] > params.window_us) + 1
        self.quiet = np.append(quiet, n)  # a match after a quiet gap opens a capture whatever came before
        self.next = np.minimum(self.beyond(seq, t), self.quiet[np.searchsorted(quiet, np.arange(n), "right")])

    def beyond(self, open_seq, open_t):
        """The first match that a capture opened there may not hold."""
        stop = np.searchsorted(self.seq, open_seq + self.params.reach, "right")
        longest = self.params.longest_us
        return np.minimum(stop, np.searchsorted(self.t, open_t + longest, "right")) if longest else stop

    def last_openers(self) -> np.ndarray:
        """For each match, if it opened a capture: the last opener of the bucket."""
        n = len(self.seq)
        link = np.where(self.next < n, self.next, np.arange(n))
        while True:  # links are followed twice as far each round
            far = link[link]
            if (far == link).all():
                return link
            link = far


class _Way:
    """How captures leave a stretch of a source, by the match that opens the next one in it.

    A capture that comes in is followed by the first match it may not hold. `seq`, `t` are such matches in order, `out_seq`,
    `out_t` the stretch's last opener if a capture opens there; matches that lead to the same one are one step, told by
    its last match. Only matches that a capture from before `start` can be followed by are steps: those up to its reach and up to the first
    quiet gap, so a stretch of any length has at most reach + 2. `shut`: no capture passes the last step."""

    LISTS = ("seq", "t", "out_seq", "out_t")

    def __init__(self, first_t: int, last_t: int, shut: bool, lists, params: CaptureParams):
        self.first_t, self.last_t, self.shut, self.params = first_t, last_t, shut, params
        self.seq, self.t, self.out_seq, self.out_t = (np.asarray(v, np.int64) for v in lists)

    @classmethod
    def of_row(cls, r, params: CaptureParams) -> _Way:
        return cls(r.first_t, r.last_t, r.shut, (getattr(r, c) for c in cls.LISTS), params)

    def row(self, host: str, node: int) -> pd.DataFrame:
        own = {"host": [host], "node": [node], "first_t": [self.first_t], "last_t": [self.last_t], "shut": [self.shut]}
        return pd.DataFrame(own | {c: [getattr(self, c).tolist()] for c in self.LISTS})

    def leave(self, seq: np.ndarray, t: np.ndarray, last_t: int) -> tuple[np.ndarray, np.ndarray]:
        """The captures that are open behind the stretch, given those open before it, where the last match was at last_t."""
        n = len(self.seq)
        if self.first_t - last_t > self.params.window_us:
            step = np.zeros(len(seq), np.int64)
        else:
            step = np.searchsorted(self.seq, seq + self.params.reach, "right")
            if self.params.longest_us:
                step = np.minimum(step, np.searchsorted(self.t, t + self.params.longest_us, "right"))
            if self.shut:
                step = np.minimum(step, n - 1)
        at, on = np.minimum(step, n - 1), step == n
        return np.where(on, seq, self.out_seq[at]), np.where(on, t, self.out_t[at])

    def then(self, later: _Way, start: int) -> _Way:
        """The way through both stretches, for captures from before `start`."""
        out_seq, out_t = later.leave(self.out_seq, self.out_t, self.last_t)
        lists, shut = [self.seq, self.t, out_seq, out_t], self.shut
        if not shut:  # a capture may pass the first stretch: what follows it is in the later one
            apart = later.first_t - self.last_t > self.params.window_us
            lists = [np.append(a, getattr(later, c)[:1] if apart else getattr(later, c)) for a, c in zip(lists, self.LISTS, strict=True)]
            shut = apart or later.shut
        return _steps(self.first_t, later.last_t, shut, lists, start, self.params)


def _steps(first_t: int, last_t: int, shut: bool, lists, start: int, params: CaptureParams) -> _Way:
    """A way without the steps that no capture from before `start` comes to, and one step for each way out."""
    seq, t, out_seq, out_t = lists
    beyond = int(np.searchsorted(seq, start + params.reach, "left"))
    if beyond < len(seq):
        seq, t, out_seq, out_t, shut = seq[: beyond + 1], t[: beyond + 1], out_seq[: beyond + 1], out_t[: beyond + 1], True
    ends = np.append(np.flatnonzero(out_seq[1:] != out_seq[:-1]), len(seq) - 1)
    return _Way(int(first_t), int(last_t), bool(shut), (seq[ends], t[ends], out_seq[ends], out_t[ends]), params)


WAY_SCHEMA = (
    "host string, node bigint, first_t bigint, last_t bigint, shut boolean, "
    "seq array<bigint>, t array<bigint>, out_seq array<bigint>, out_t array<bigint>"
)
INTO_SCHEMA = "host string, node bigint, into_seq bigint, into_t bigint, before_t bigint"


def _bucket_way(params: CaptureParams, size: int):
    """The way through one bucket of matches."""

    def rows(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        bucket, node = _Bucket(group["seq"].to_numpy(), group["t"].to_numpy(), params), int(key[1])
        out, most = bucket.last_openers(), int(bucket.quiet[0]) + 1  # the match behind the first quiet gap is the last step
        lists = [bucket.seq[:most], bucket.t[:most], bucket.seq[out[:most]], bucket.t[out[:most]]]
        return _steps(bucket.t[0], bucket.t[-1], most <= len(out), lists, node * size, params).row(key[0], node)

    return rows


def _joined_way(params: CaptureParams, size: int):
    """The way through all stretches of a group, one after the other; `size` lines a group."""

    def rows(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ways = [_Way.of_row(r, params) for r in group.sort_values("node").itertuples(index=False)]
        start, way = int(key[1]) * size, ways[0]
        for later in ways[1:]:
            way = way.then(later, start)
        return way.row(key[0], int(key[1]))

    return rows


def _handed_down(params: CaptureParams):
    """Go through the stretches of a group in order, given the capture that comes into it; give each the one that comes into it."""

    def rows(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values("node"), []
        into, before = group["into_seq"].iloc[0], group["before_t"].iloc[0]
        open_ = None if pd.isna(into) else (int(into), int(group["into_t"].iloc[0]))
        last = None if pd.isna(before) else int(before)
        for r in group.itertuples(index=False):
            way = _Way.of_row(r, params)
            comes = open_ if open_ is not None and way.first_t - last <= params.window_us else None
            out.append((key[0], r.node, *(comes or (None, None)), last))
            if comes is None:
                open_ = int(way.out_seq[0]), int(way.out_t[0])  # the first match opens a capture
            else:
                seq, t = way.leave(np.array(comes[:1]), np.array(comes[1:]), last)
                open_ = int(seq[0]), int(t[0])
            last = way.last_t
        return pd.DataFrame(out, columns=["host", "node", "into_seq", "into_t", "before_t"]).astype(
            {"into_seq": "Int64", "into_t": "Int64", "before_t": "Int64"}
        )

    return rows


def _captures_into(ways: DataFrame, params: CaptureParams, size: int, group: int) -> DataFrame:
    """The capture that comes into each bucket. Ways are joined by `group` at a time until a source has one group, and the
    captures are handed down again: a task reads the ways of `group` stretches, however many a source has."""
    levels, width = [ways], size
    last = ways.agg(F.max("node").alias("n")).first()["n"] or 0
    while last >= group:
        last, width = last // group, width * group
        above = levels[-1].groupBy("host", F.call_function("div", F.col("node"), F.lit(group).cast("long")).alias("up"))
        levels.append(stored(above.applyInPandas(_joined_way(params, width), WAY_SCHEMA), "ways"))
    none = F.lit(None).cast("long")
    into = None
    for level in reversed(levels):
        rows = level.withColumn("up", F.call_function("div", F.col("node"), F.lit(group).cast("long")))
        if into is None:
            rows = rows.withColumns({"into_seq": none, "into_t": none, "before_t": none})
        else:
            rows = rows.join(into.withColumnRenamed("node", "up"), ["host", "up"])
        into = rows.groupBy("host", "up").applyInPandas(_handed_down(params), INTO_SCHEMA)
    return into.select("host", F.col("node").alias("bucket"), "into_seq", "into_t")


def _cut(params: CaptureParams):
    """The captures of one bucket, given the one that comes into it: a part of it may be there."""

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        bucket = _Bucket(group["seq"].to_numpy(), group["t"].to_numpy(), params)
        n, into, out, at = len(group), group["into_seq"].iloc[0], [], 0
        if not pd.isna(into):
            open_seq, open_t = int(into), int(group["into_t"].iloc[0])
            at = int(min(bucket.beyond(open_seq, open_t), bucket.quiet[0]))
            if at:
                out.append((open_seq, open_t, 0, at - 1))
        while at < n:
            stop = int(bucket.next[at])
            out.append((bucket.seq[at], bucket.t[at], at, stop - 1))
            at = stop
        first, last = np.array([o[2] for o in out], int), np.array([o[3] for o in out], int)
        return pd.DataFrame({
            "host": group["host"].iloc[0], "open_seq": [o[0] for o in out], "open_t": [o[1] for o in out],
            "last_seq": bucket.seq[last], "last_t": bucket.t[last], "n_matches": last - first + 1,
        })

    return rows


CUT_SCHEMA = "host string, open_seq bigint, open_t bigint, last_seq bigint, last_t bigint, n_matches bigint"


def find_captures(matches: DataFrame, params: CaptureParams, size: int = BUCKET, group: int = GROUP) -> DataFrame:
    """Captures with all limits: one row per capture with its opener, its last match, the
    time it lasts `until`, and the highest line number it may reach.

    Where a capture ends depends on where it began, along a whole source. In each bucket the way
    from every opener that a capture from before may lead to, to the bucket's last one, is worked out by itself; ways are joined
    in levels, which gives every bucket the capture that comes into it, and then the buckets are cut by themselves.
    """
    rows = matches.select("host", bucket_of(F.col("seq"), size).alias("bucket"), "seq", "t")
    ways = stored(rows.groupBy("host", "bucket").applyInPandas(_bucket_way(params, size), WAY_SCHEMA), "ways")
    into = _captures_into(ways, params, size, group)
    parts = rows.join(into, ["host", "bucket"]).groupBy("host", "bucket").applyInPandas(_cut(params), CUT_SCHEMA)
    found = parts.groupBy("host", "open_seq", "open_t").agg(
        F.max("last_seq").alias("last_seq"), F.max("last_t").alias("last_t"), F.sum("n_matches").alias("n_matches")
    )
    until = F.col("last_t") + params.window_us
    if params.longest_us:
        until = F.least(until, F.col("open_t") + params.longest_us)
    return found.select(
        "host", "open_seq", "open_t", "last_seq", "last_t", "n_matches",
        until.alias("until"), (F.col("open_seq") + params.reach).alias("limit_seq"),
    )


def line_index(lines: DataFrame, size: int = BUCKET) -> DataFrame:
    """First and last time of every bucket of lines."""
    return (
        lines.select("host", bucket_of(F.col("seq"), size).alias("bucket"), "seq", "t")
        .groupBy("host", "bucket")
        .agg(F.min("t").alias("low_t"), F.max("t").alias("high_t"), F.max("seq").alias("high_seq"))
    )


def _openings(captures: DataFrame, index: DataFrame, params: CaptureParams, size: int) -> DataFrame:
    """Rows (host, bucket, at, rank, event) saying which capture is current and which is
    next from line `at` on. A capture is repeated at the start of each later bucket that
    can still hold one of its lines or a context line of the next capture."""
    this = F.struct("open_seq", "open_t", "until", "limit_seq")
    rows = captures.select("host", "open_seq", "open_t", "until", "limit_seq")
    chained = neighbours(rows, ["host"], this, "open_seq", size)
    nothing = F.lit(None).cast("struct<open_seq:bigint,open_t:bigint,until:bigint,limit_seq:bigint>")
    # What holds from a capture's opener on, and, for a source's first capture, before it.
    states = F.array(
        F.struct(this.alias("now"), F.col("after").alias("next")),
        F.when(F.col("before").isNull(), F.struct(nothing.alias("now"), this.alias("next"))),
    )
    states = chained.select("host", F.explode(F.filter(states, lambda s: s.isNotNull())).alias("event"))
    now, nxt = "event.now", "event.next"
    own_bucket = bucket_of(F.col(f"{now}.open_seq"), size)
    states = states.join(index.groupBy("host").agg(F.max("high_seq").alias("_end")), "host")
    reach = F.least(F.col(f"{now}.limit_seq"), F.col("_end"))
    last_bucket = bucket_of(F.coalesce(F.col(f"{nxt}.open_seq"), reach), size)
    zero = F.lit(0).cast("long")
    spread = states.select(
        "host", "event", F.explode(F.sequence(F.coalesce(own_bucket, zero), F.greatest(last_bucket, own_bucket, zero))).alias("bucket")
    )
    opens = F.coalesce(F.col("bucket") == own_bucket, F.lit(False))
    holds = (F.col("bucket") * size <= F.col(f"{now}.limit_seq")) & (F.col("low_t") <= F.col(f"{now}.until"))
    leads = F.col("high_t") >= F.col(f"{nxt}.open_t") - params.window_us
    return (
        spread.join(index, ["host", "bucket"])
        .where(opens | F.coalesce(holds, F.lit(False)) | F.coalesce(leads, F.lit(False)))
        .select(
            "host", "bucket", F.when(opens, F.col(f"{now}.open_seq")).otherwise(F.col("bucket") * size).alias("at"),
            F.when(opens, 1).otherwise(0).alias("rank"), "event",
        )
    )


def capture_lines(
    labelled: DataFrame, captures: DataFrame, params: CaptureParams, size: int = BUCKET
) -> DataFrame:
    """Every captured line with its one owner and role: open, match, after or context.

    A line belongs to the capture open when it was read, else as context to the next
    capture if it is at most capture_time older. In each bucket, lines and openings are
    sorted together and the latest opening is carried down, so no line meets more than one
    capture. Lines of buckets that no capture touches are left out by a semi join on (source, bucket).
    """
    index = line_index(labelled, size)
    events = stored(_openings(captures, index, params, size), "openings")
    extra = [c for c in ("always",) if c in labelled.columns]
    lines = labelled.withColumn("bucket", bucket_of(F.col("seq"), size))
    lines = lines.join(events.select("host", "bucket").distinct(), ["host", "bucket"], "left_semi").select(
        "host", "bucket", F.col("seq").alias("at"), F.lit(2).alias("rank"), "ts", "t", "line", "label", *extra
    )
    latest = Window.partitionBy("host", "bucket").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        lines.unionByName(events, allowMissingColumns=True)
        .withColumn("event", F.last("event", ignorenulls=True).over(latest))
        .where(F.col("rank") == 2)
    )
    seq, now, nxt = F.col("at"), "event.now", "event.next"
    member = (seq <= F.col(f"{now}.limit_seq")) & (F.col("t") <= F.col(f"{now}.until"))
    ahead = (seq < F.col(f"{nxt}.open_seq")) & (F.col("t") >= F.col(f"{nxt}.open_t") - params.window_us)
    role = (
        F.when(member & (seq == F.col(f"{now}.open_seq")), "open")
        .when(member & F.col("label").isNotNull(), "match")
        .when(member, "after")
        .when(ahead, "context")
    )
    held = F.col("role") != "context"
    return (
        rows.withColumn("role", role)
        .where(F.col("role").isNotNull())
        .select(
            "host",
            F.when(held, F.col(f"{now}.open_seq")).otherwise(F.col(f"{nxt}.open_seq")).alias("open_seq"),
            F.when(held, F.col(f"{now}.open_t")).otherwise(F.col(f"{nxt}.open_t")).alias("open_t"),
            F.when(held, F.col(f"{now}.until")).alias("until"),
            seq.alias("seq"), "ts", "t", "role", F.col("label").isNotNull().alias("is_match"), "line", "label", *extra,
        )
    )


def captured_lines(labelled: DataFrame, params: CaptureParams, size: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The whole path from labelled lines: (captures, captured lines), each written once, as
    most later operators read them more than once."""
    captures = stored(find_captures(match_rows(labelled), params, size), "captures")
    return captures, stored(capture_lines(labelled, captures, params, size), "held")


def capture_members(held: DataFrame) -> DataFrame:
    """The lines from each opener to its capture's end."""
    return held.where(F.col("role") != "context")


def capture_summary(held: DataFrame, ends: DataFrame, params: CaptureParams) -> DataFrame:
    """One row per capture: pattern, matched line (opening_line as it was read), span, counts and why it ended.
    `ends` gives each source's last line time (host, end_t)."""
    after = F.col("role").isin("match", "after")
    member = F.col("role") != "context"
    # Numbers only, so the partial sums stay in hash aggregation; texts come from the opener's row.
    rolled = held.groupBy("host", "open_seq", "open_t").agg(
        F.max("until").alias("until"),
        F.max(F.when(member, F.col("seq"))).alias("end_seq"),
        F.max(F.when(member, F.col("t"))).alias("end_t"),
        F.count_if(after).alias("lines_after"),
        F.count_if(~member).alias("context_lines"),
        F.count_if(F.col("is_match") & member).alias("n_matches"),
    )
    openers = held.where(F.col("role") == "open").select(
        "host", "open_seq", F.col("label").alias("pattern"), strip(F.col("line")).alias("matched_line"),
        F.col("line").alias("opening_line"),
    )
    longest = F.lit(bool(params.longest_us)) & (F.col("until") == F.col("open_t") + params.longest_us)
    reason = (
        F.when(F.col("lines_after") > params.line_count_max, "line_cap")
        .when(F.col("end_t_host") <= F.col("until"), "end_of_input")
        .when(longest, "time_max")
        .otherwise("time")
    )
    return (
        rolled.join(openers, ["host", "open_seq"])
        .join(ends.select("host", F.col("end_t").alias("end_t_host")), "host")
        .withColumn("end_reason", reason)
        .withColumn("capture_id", capture_id())
        .drop("end_t_host")
    )


def source_ends(lines: DataFrame) -> DataFrame:
    """The time of each source's last line; written, so that joins know how few rows there are."""
    return stored(lines.groupBy("host").agg(F.max("t").alias("end_t")), "source-ends")


def always_notify_rollup(held: DataFrame) -> DataFrame:
    """Per capture: whether a matched line passed the always-notify patterns, and the first that did."""
    hit = F.col("always") & F.col("is_match") & (F.col("role") != "context")
    firsts = held.groupBy("host", "open_seq").agg(F.min(F.when(hit, F.col("seq"))).alias("seq"))
    texts = held.where(hit).select("host", "open_seq", "seq", strip(F.col("line")).alias("always_notify_line"))
    return firsts.join(texts, ["host", "open_seq", "seq"], "left").select(
        "host", "open_seq", F.col("seq").isNotNull().alias("always_notify"), "always_notify_line"
    )


def run_counters(labelled: DataFrame) -> DataFrame:
    """Per source: lines processed, lines matched, and full ten thousands reported as progress."""
    counted = labelled.groupBy("host").agg(F.count("*").alias("lines"), F.count("label").alias("matched"))
    return counted.withColumn("progress", F.call_function("div", F.col("lines"), F.lit(10000).cast("long")))


def observed(labelled: DataFrame, observation: Observation) -> DataFrame:
    """The same lines, with lines and matched counted while another query reads them."""
    return labelled.observe(observation, F.count(F.lit(1)).alias("lines"), F.count("label").alias("matched"))
