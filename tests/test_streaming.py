import json
import random
import time

import pytest
from brute import fold
from pyspark.errors import StreamingQueryException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loglantern.operators.captures import observed, run_counters
from loglantern.operators.matching import PatternSet
from loglantern.operators.retention import read_rendered
from loglantern.params import CaptureParams, RequestParams
from loglantern.plans.catalog import until_tick
from loglantern.sources.lines import LINE_SCHEMA, catch_up, stream_log_lines, stream_text_lines
from loglantern.streaming.batches import (
    TICK, CaptureStream, answered, captured_stream_lines, closed_captures, fixed, late_lines, outbox, posted,
)

WATCH = PatternSet.of(texts=["HIT"])


def rows_of(seed, hosts=3, length=40):
    rng = random.Random(seed)
    rows = []
    for h in range(hosts):
        at = 0
        for seq in range(1, length + 1):
            at += rng.choice([0, 1, 2, 9, 15])
            rows.append((f"h{h}", seq, at, f"HIT {seq}" if rng.random() < 0.3 else f"line {seq}"))
    return rows


def play(spark, base, files, params, delay=None):
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH), params, delay=delay, size=8)
    for rows in files:
        df = spark.createDataFrame(rows, "host string, seq bigint, s bigint, line string")
        df.withColumn("ts", F.timestamp_seconds("s")).selectExpr("host", "seq", "ts", "line").write.mode("append").parquet(f"{base}/in")
        stream.start(stream_log_lines(spark, f"{base}/in", LINE_SCHEMA), f"{base}/checkpoint", available_now=True).awaitTermination()
    return stream


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_equals_line_by_line(spark, tmp_path, cuts):
    rows = rows_of(cuts)
    params = CaptureParams(12, 40, 6)
    step = max(r[2] for r in rows) // cuts + 1
    files = [[r for r in rows if r[2] // step == i] for i in range(cuts)]
    play(spark, tmp_path, files, params)
    got = {}
    for r in captured_stream_lines(spark, f"{tmp_path}/out").collect():
        got.setdefault((r["host"], r["open_seq"]), []).append(r["seq"])
    closed = {(r["host"], r["open_seq"]): (r["until"] // 10**6, r["end_reason"]) for r in closed_captures(spark, f"{tmp_path}/out").collect()}
    want, ended = {}, {}
    for host in {r[0] for r in rows}:
        for c in fold([(s, t, "HIT" in line) for h, s, t, line in rows if h == host], 12, 40, 6):
            want[(host, c.open_seq)] = c.context + c.members
            if c.reason != "end_of_input":
                ended[(host, c.open_seq)] = (c.until, c.reason)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert closed == ended


def test_quiet_close_late_lines_and_rerun(spark, tmp_path):
    params = CaptureParams(10, 0, 100)
    first = [("a", 1, 100, "HIT"), ("b", 1, 100, "x")]
    second = [("b", 2, 150, "x"), ("a", 1, 100, "HIT")]
    third = [("a", 2, 104, "slow source"), ("a", 3, 160, "HIT"), ("b", 3, 161, "HIT")]
    stream = play(spark, tmp_path, [first, second, third], params, delay=20)
    out = f"{tmp_path}/out"
    assert [(r["host"], r["open_seq"], r["end_reason"]) for r in closed_captures(spark, out).collect()] == [("a", 1, "time")]
    assert sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, out).collect()) == [("a", 1), ("a", 3), ("b", 3)]
    # a line is late by its own source's newest line, and is kept
    assert [(r["host"], r["seq"], r["line"], r["batch"]) for r in late_lines(spark, stream).collect()] == [("a", 1, "HIT", 1)]
    # A batch that runs again replaces its own output.
    again = spark.createDataFrame(third, "host string, seq bigint, s bigint, line string").withColumn("ts", F.timestamp_seconds("s"))
    stream(again, 2)
    assert sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, out).collect()) == [("a", 1), ("a", 3), ("b", 3)]


def test_a_clock_closes_what_is_quiet_and_requests_are_written(spark, tmp_path):
    base, params = str(tmp_path), CaptureParams(10, 0, 100)
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH), params, delay=20, size=8, requests=RequestParams(events=True))
    rows = [("a", 1, 95, "before"), ("a", 2, 100, " HIT "), ("a", 3, 105, "after")]
    df = spark.createDataFrame(rows, "host string, seq bigint, s bigint, line string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    stream(df, 0)
    assert spark.read.parquet(f"{base}/out/closed").count() == 0
    for batch, at in ((1, 129), (2, 131)):
        stream(spark.createDataFrame([(None, None, None, None)], TICK).withColumn("ts", F.timestamp_seconds(F.lit(at))), batch)
        assert spark.read.parquet(f"{base}/out/closed").count() == batch - 1
    row = closed_captures(spark, f"{base}/out").first()
    assert (row["host"], row["open_seq"], row["matched_line"], row["lines_after"], row["context_lines"], row["end_reason"]) == ("a", 2, "HIT", 1, 1, "time")
    texts = read_rendered(spark, f"{base}/out/texts/batch=2")
    found = [r["text"] for r in texts.where(F.col("path") == row["path"]).orderBy("part", "pos").collect()]
    assert found[2] == "Matched line:     HIT " and "before" in found and "-> HIT" in found and "after" in found
    event = json.loads(outbox(spark, f"{base}/out", "events").first()["event"])
    assert event["path"] == row["path"] and "-> HIT" in event["excerpt"] and not event["push"]


def test_a_killed_batch_shows_nothing(spark, tmp_path, monkeypatch):
    """A batch that fails between its tables is hidden from readers until it has run whole."""
    params, out = CaptureParams(10, 0, 100), f"{tmp_path}/out"
    stream = play(spark, tmp_path, [[("a", 1, 100, "HIT"), ("a", 2, 105, "x")]], params)
    before = sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, out).collect())
    assert before == [("a", 1), ("a", 2)]
    later = spark.createDataFrame([("a", 3, 300, "HIT")], "host string, seq bigint, s bigint, line string").withColumn("ts", F.timestamp_seconds("s"))
    whole = CaptureStream._closing

    def killed(self, *rest):
        raise RuntimeError("killed")

    monkeypatch.setattr(CaptureStream, "_closing", killed)
    with pytest.raises(RuntimeError, match="killed"):
        stream(later, 1)
    assert spark.read.parquet(f"{out}/lines").count() == 3  # written, but not ended
    assert sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, out).collect()) == before
    assert closed_captures(spark, out).count() == 0
    monkeypatch.setattr(CaptureStream, "_closing", whole)
    stream(later, 1)
    assert sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, out).collect()) == [*before, ("a", 3)]
    assert [(r["open_seq"], r["end_reason"]) for r in closed_captures(spark, out).collect()] == [(1, "time")]


def test_text_closes_by_its_trigger_alone(spark, tmp_path):
    """No further file comes; the clock that runs with the stream closes what is open."""
    base = str(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-01T00:00:00Z one\n2024-01-01T00:00:30Z HIT\n")
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH), CaptureParams(60, 0, 100), delay=30, size=8)
    run = stream.start(stream_text_lines(spark, f"{base}/in", "h"), f"{base}/c", seconds=1)
    try:
        for _ in range(240):
            time.sleep(0.5)
            if (tmp_path / "out" / "committed").exists() and closed_captures(spark, f"{base}/out").count():
                break
    finally:
        run.stop()
    assert [(r["open_seq"], r["lines_after"], r["end_reason"]) for r in closed_captures(spark, f"{base}/out").collect()] == [(2, 0, "time")]


def test_a_clock_goes_on_from_what_was_caught_up(spark, tmp_path):
    """Backlog is read a file a batch while the clock stands still; then, on the same checkpoint, it closes what is open, once."""
    base, params = str(tmp_path), CaptureParams(10, 0, 100)
    files = [[("a", 1, 100, "HIT"), ("b", 1, 100, "HIT")], [("a", 2, 105, "x"), ("b", 2, 120, "HIT")], [("a", 3, 109, "x")]]
    for rows in files:
        df = spark.createDataFrame(rows, "host string, seq bigint, s bigint, line string").withColumn("ts", F.timestamp_seconds("s"))
        df.selectExpr("host", "seq", "ts", "line").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH), params, delay=20, size=8)
    closed = lambda: sorted((r["host"], r["open_seq"], r["lines_after"]) for r in closed_captures(spark, f"{base}/out").collect())
    for _ in range(2):
        source = stream_log_lines(spark, f"{base}/in", LINE_SCHEMA, files_per_batch=1)
        stream.start(source, f"{base}/c", available_now=True, clock=True).awaitTermination()
        assert closed() == [("b", 1, 0)]
    assert sum(spark.read.parquet(f"{base}/out/lines/batch={n}").count() > 0 for n in range(3)) == 3
    until_tick(stream, stream_log_lines(spark, f"{base}/in", LINE_SCHEMA, files_per_batch=1), f"{base}/c")
    assert closed() == [("a", 1, 2), ("b", 1, 0), ("b", 2, 0)]
    assert sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, f"{base}/out").collect()) == [
        ("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)
    ]


def test_an_output_is_one_checkpoints(spark, tmp_path):
    """Batches begun anew over those of another checkpoint would be read with what is left of these."""
    params = CaptureParams(10, 0, 100)
    stream = play(spark, tmp_path, [[("a", 1, 100, "HIT")], [("a", 2, 300, "HIT")]], params)
    before = sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, stream.output).collect())
    source = stream_log_lines(spark, f"{tmp_path}/in", LINE_SCHEMA)
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        stream.start(source, f"{tmp_path}/other", available_now=True).awaitTermination()
    assert sorted((r["host"], r["seq"]) for r in captured_stream_lines(spark, stream.output).collect()) == before == [("a", 1), ("a", 2)]


def test_model_answers_and_failed_posts_come_back(spark, tmp_path):
    base, params = str(tmp_path), CaptureParams(10, 0, 100)
    lines = [("a", 1, 100, "HIT one"), ("a", 2, 300, "HIT two"), ("a", 3, 600, "HIT three"), ("a", 4, 900, "x")]
    df = spark.createDataFrame(lines, "host string, seq bigint, s bigint, line string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    asks = RequestParams(model=True)
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH), params, size=8, requests=asks)
    stream(df, 0)
    asked = outbox(spark, f"{base}/out", "model_requests").collect()
    assert sorted(r["open_seq"] for r in asked) == [1, 2, 3] and all("HIT" in r["request"] for r in asked)
    replies = [("a", 1, '{"title": "t", "summary": "s", "notify": true}'), ("a", 2, '{"title": "t", "summary": "s", "notify": false}'), ("a", 3, None)]
    pushes = answered(spark, f"{base}/out", spark.createDataFrame(replies, "host string, open_seq bigint, reply string"), asks).collect()
    assert sorted((r["open_seq"], r["title"]) for r in pushes) == [(1, "t"), (3, "a: *HIT*")]
    results = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "host string, open_seq bigint, post_failed boolean")
    assert posted(spark, f"{base}/out", results, RequestParams(events=True)).count() == 0  # only always-notify captures are pushed
    stream.patterns = fixed(WATCH, PatternSet.of(texts=["one"]))
    stream.output, stream.state, stream.requests = f"{base}/out2", f"{base}/state2", RequestParams(events=True)
    stream(df, 0)
    assert [r["open_seq"] for r in posted(spark, f"{base}/out2", results, stream.requests).collect()] == [1]


def test_a_slice_that_comes_twice_is_not_late(spark, tmp_path):
    params = CaptureParams(12, 40, 6)
    rows = [(h, seq, s + 1_000_000, line) for h, seq, s, line in rows_of(9, hosts=2, length=20)]
    once, twice = [rows], [rows[:25], rows[:25], rows[25:]]
    played = []
    for name, files, unique in (("a", once, None), ("b", twice, 10_000)):
        base = f"{tmp_path}/{name}"
        stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH), params, size=8, unique=unique)
        for part in files:
            df = spark.createDataFrame(part, "host string, seq bigint, s bigint, line string").withColumn("ts", F.timestamp_seconds("s"))
            df.selectExpr("host", "seq", "ts", "line").write.mode("append").parquet(f"{base}/in")
            stream.start(stream_log_lines(spark, f"{base}/in", LINE_SCHEMA), f"{base}/checkpoint", available_now=True).awaitTermination()
        assert late_lines(spark, stream).count() == 0
        played.append(sorted((r["host"], r["open_seq"], r["seq"]) for r in captured_stream_lines(spark, stream.output).collect()))
    assert played[0] == played[1]


def test_text_files_are_numbered_on(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "in").mkdir()
    stream = CaptureStream(f"{base}/out", f"{base}/state", fixed(WATCH), CaptureParams(60, 0, 100), size=8)
    for name, text in (("a.log", "2024-01-01T00:00:00Z one\n\n no stamp HIT\n"), ("b.log", "2024-01-01T00:00:30Z two\n2024-01-01T00:05:00Z HIT\n")):
        (tmp_path / "in" / name).write_text(text)
        stream.start(stream_text_lines(spark, f"{base}/in", "h"), f"{base}/c", available_now=True).awaitTermination()
    got = sorted((r["open_seq"], r["seq"], r["role"]) for r in captured_stream_lines(spark, f"{base}/out").collect())
    assert got == [(2, 1, "context"), (2, 2, "open"), (2, 3, "after"), (4, 4, "open")]


def test_context_bytes_bound_the_state(spark, tmp_path):
    params = CaptureParams(1000, 0, 100, context_bytes=14)
    stream = play(spark, tmp_path, [[("a", i, i, f"line {i}") for i in range(1, 9)], [("a", 9, 9, "HIT")]], params)
    kept = spark.read.parquet(f"{stream.state}/0/lines")
    assert sorted(r["seq"] for r in kept.collect()) == [7, 8]
    got = captured_stream_lines(spark, stream.output).collect()
    assert sorted((r["seq"], r["role"]) for r in got) == [(7, "context"), (8, "context"), (9, "open")]


def test_text_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"one\r\n\n \ntwo\xff\n")
    source = stream_text_lines(spark, f"{tmp_path}/in", "h")
    query = source.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sorted((r["host"], r["line"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("h", "one\r"), ("h", "two�")]


def test_text_lines_of_several_sources(spark, tmp_path):
    for host in ("a", "b"):
        (tmp_path / "in" / f"host={host}").mkdir(parents=True)
        (tmp_path / "in" / f"host={host}" / "x.log").write_text(f"one {host}\n")
    host = F.regexp_extract(F.col("_metadata.file_path"), "host=([^/]+)/", 1)
    source = stream_text_lines(spark, f"{tmp_path}/in", host)
    query = source.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sorted((r["host"], r["line"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "one a"), ("b", "one b")]


def test_counters_while_reading(spark):
    df = spark.createDataFrame([("h", "x", None), ("h", "HIT", "*HIT*")], "host string, line string, label string")
    seen = Observation("run")
    observed(df, seen).collect()
    assert seen.get == {"lines": 2, "matched": 1}
    assert tuple(run_counters(df).first()) == ("h", 2, 1, 0)


def test_catch_up(spark):
    df = spark.sql("SELECT timestamp_seconds(s) AS ts, s FROM VALUES (99), (100), (150) AS t(s)")
    kept = catch_up(df, F.timestamp_seconds(F.lit(200)), 100).collect()
    assert sorted(r["s"] for r in kept) == [100, 150]
