import random

import pytest
from brute import fold
from pyspark.sql import functions as F

from loglantern.operators import captures as cap
from loglantern.operators import context as ctx
from loglantern.params import CaptureParams
from loglantern.plans.scratch import stored

S = 1_000_000


def run(labelled, params, size=65536):
    found = stored(cap.find_captures(cap.match_rows(labelled), params, size), "found")
    held = stored(cap.capture_lines(labelled, found, params, size), "held")
    return found, held


def lines_of(held, host="h"):
    out = {}
    for r in sorted(held.where(F.col("host") == host).collect(), key=lambda r: r["seq"]):
        out.setdefault(r["open_seq"], []).append(r["line"])
    return out


def test_repeating_hits_end_at_the_longest_duration(log):
    labelled = log({"h": [(0, "HIT 1"), (50, "HIT 2"), (100, "HIT 3"), (150, "HIT 4"), (151, "tail")]})
    _, held = run(labelled, CaptureParams(60, 120))
    assert lines_of(held) == {1: ["HIT 1", "HIT 2", "HIT 3"], 4: ["HIT 4", "tail"]}


def test_line_cap_writes_one_more_line_than_the_cap(log):
    rows = [(i, f"pre-{i}") for i in range(10)] + [(10, "HIT")] + [(11 + i, f"post-{i}") for i in range(10)]
    _, held = run(log({"h": rows}), CaptureParams(60, 3600, 3))
    assert lines_of(held)[11] == [f"pre-{i}" for i in range(10)] + ["HIT", "post-0", "post-1", "post-2", "post-3"]


def test_cap_zero(log):
    _, held = run(log({"h": [(0, "HIT 1"), (0, "HIT 2"), (0, "HIT 3")]}), CaptureParams(60, 3600, 0))
    assert lines_of(held) == {1: ["HIT 1", "HIT 2"], 3: ["HIT 3"]}


def test_bounds_are_inclusive(log):
    rows = [(0, "too old"), (1, "oldest"), (61, "HIT"), (121, "last"), (121.000001, "after")]
    _, held = run(log({"h": rows}), CaptureParams(60, 0))
    assert lines_of(held) == {3: ["oldest", "HIT", "last"]}


def test_storm_writes_every_line_once(log):
    rows = [(i / 10, f"ctx {i}") for i in range(50)] + [(5, "HIT 1")] + [(5, f"a {i}") for i in range(20)] + [(6, "HIT 2"), (6, "b")]
    labelled = log({"h": rows})
    found, held = run(labelled, CaptureParams(60, 3600, 10))
    written = [line for lines in lines_of(held).values() for line in lines]
    assert sorted(written) == sorted(text for _, text in rows)
    capped = ctx.context_windows(held, CaptureParams(60, 3600, 10))
    summary = cap.capture_summary(held, cap.source_ends(labelled), CaptureParams(60, 3600, 10))
    left = ctx.left_out_counts(ctx.held_ranges(capped, summary)).collect()
    assert [(r["open_seq"], r["held_by_seq"], r["n"]) for r in left] == [(72, 51, 62)]


def test_always_notify_counts_only_matched_lines(log):
    rows = [(0, "I/O error quoted"), (1, "HIT first"), (2, "I/O error alone"), (3, "HIT I/O error"), (4, "HIT again I/O error")]
    labelled = log({"h": rows, "k": [(0, "HIT")]})
    _, held = run(labelled, CaptureParams(60, 3600))
    got = {r["host"]: (r["always_notify"], r["always_notify_line"]) for r in cap.always_notify_rollup(held).collect()}
    assert got == {"h": (True, "HIT I/O error"), "k": (False, None)}


def random_hosts(seed, hosts, length):
    rng = random.Random(seed)
    made = {}
    for h in range(hosts):
        at, rows, p = 0.0, [], rng.choice([0.05, 0.3, 0.9, 1.0])
        for i in range(rng.randint(1, length)):
            at += rng.choice([0, 0, 1, 1, 2, 5, 9, 30])
            rows.append((at, f"HIT {i}" if rng.random() < p else f"line {i} " + "x" * rng.randint(0, 9)))
        made[f"h{h}"] = rows
    return made


CASES = [
    # T, M, cap, bucket, bytes of context
    (10, 25, 4, 4, 60),
    (10, 25, 4, 7, 60),
    (5, 0, 2, 3, 30),
    (0, 0, 3, 5, 1),
    (0, 9, 0, 4, 500),
    (60, 12, 1000, 8, 200),
    (60, 0, 7, 3, 200),
]


def folded(rows, params):
    """(open_seq, until, last match, matches) of each capture of the model."""
    model = [(i, int(at * S), "HIT" in text) for i, (at, text) in enumerate(rows, 1)]
    hit = {seq for seq, _, matched in model if matched}
    captures = fold(model, params.window_us, params.longest_us, params.line_count_max)
    return [(c.open_seq, c.until, max(hit & set(c.members)), len(hit & set(c.members))) for c in captures]


def found_in(found, host):
    return sorted((r["open_seq"], r["until"], r["last_seq"], r["n_matches"]) for r in found if r["host"] == host)


@pytest.mark.parametrize("T,M,most", [(10, 0, 6), (10, 25, 4), (0, 0, 2), (1000, 0, 37), (1000, 90, 1000)])
def test_dense_matches_over_a_thousand_buckets(log, T, M, most):
    """One source in which every line matches and nothing is quiet: levels of eight give what a fold gives."""
    rows = [(i * 0.5, f"HIT {i}") for i in range(4000)]
    params = CaptureParams(T, M, most)
    found = cap.find_captures(cap.match_rows(log({"h": rows})), params, 4, 8).collect()
    assert found_in(found, "h") == folded(rows, params)


@pytest.mark.parametrize("T,M,most,size,budget", CASES)
def test_levels_against_model(log, T, M, most, size, budget):
    hosts = random_hosts(T * 17 + M + most, 40, 120)
    params = CaptureParams(T, M, most)
    for group in (2, 3):
        found = cap.find_captures(cap.match_rows(log(hosts)), params, size, group).collect()
        for host, rows in hosts.items():
            assert found_in(found, host) == folded(rows, params)


def test_ways_are_bounded(log, spark):
    """A way's steps are at most reach + 2, however many stretches are joined."""
    rows = [(i * 0.1, f"HIT {i}") for i in range(3000)]
    params = CaptureParams(60, 0, 20)
    matches = cap.match_rows(log({"h": rows})).select("host", F.expr("seq div 100").alias("bucket"), "seq", "t")
    ways = matches.groupBy("host", "bucket").applyInPandas(cap._bucket_way(params, 100), cap.WAY_SCHEMA)
    wide = ways.groupBy("host", F.expr("node div 10").alias("up")).applyInPandas(cap._joined_way(params, 1000), cap.WAY_SCHEMA)
    for level in (ways, wide):
        assert all(1 <= len(r["seq"]) <= params.reach + 2 for r in level.collect())


@pytest.mark.parametrize("T,M,most,size,budget", CASES)
def test_against_line_by_line_model(log, T, M, most, size, budget):
    hosts = random_hosts(T * 31 + M * 7 + most, 25, 70)
    params = CaptureParams(T, M, most, budget)
    labelled = stored(log(hosts), "log")
    found, held = run(labelled, params, size)
    spans = stored(ctx.overlapping_context(held, found, params, size), "spans")
    capped = ctx.context_windows(held, params, size)
    wide = ctx.context_windows(held, CaptureParams(T, M, most, 10**9), size)
    summary = cap.capture_summary(held, cap.source_ends(labelled), params)
    reusable = summary.withColumn("reusable", F.col("open_seq") % 3 != 0)
    ranges = stored(ctx.held_ranges(wide, reusable, size), "ranges")

    own, roles, windows, written, left, ends, kept, trimmed = {}, {}, {}, {}, {}, {}, {}, {}
    expected_kept, expected_own = {}, {}
    expect = {n: {} for n in ("members", "windows", "written", "left", "ends")}
    for host, rows in hosts.items():
        texts = [text for _, text in rows]
        model = [(i, int(at * S), "HIT" in text) for i, (at, text) in enumerate(rows, 1)]
        for c in fold(model, T * S, M * S, most):
            key = (host, c.open_seq)
            expect["members"][key] = c.members
            expect["windows"][key] = c.window
            expect["ends"][key] = (c.reason, c.after, len(c.context), c.until)
            expected_own[key] = c.context
            kept_lines, used = [], 0
            for s in reversed(c.window):
                used += len(texts[s - 1].encode()) + 1
                if used > budget and kept_lines:
                    break
                kept_lines.append(s)
            expected_kept[key] = (min(kept_lines, default=c.open_seq), len(kept_lines), len(kept_lines) < len(c.window))
        for c in fold(model, T * S, M * S, most, reusable=lambda seq: seq % 3 != 0):
            key = (host, c.open_seq)
            expect["written"][key] = c.context
            expect["left"][key] = c.left_out

    for r in held.select("host", "open_seq", "seq", "role").collect():
        (own if r["role"] == "context" else roles).setdefault((r["host"], r["open_seq"]), []).append(r["seq"])
    assert {k: sorted(v) for k, v in roles.items()} == expect["members"]
    assert {k: sorted(v) for k, v in own.items()} == {k: v for k, v in expected_own.items() if v}

    for r in ctx.lookback_context(held, spans, size).collect():
        windows.setdefault((r["host"], r["open_seq"]), []).append(r["seq"])
    assert {k: sorted(v) for k, v in windows.items()} == {k: v for k, v in expect["windows"].items() if v}
    assert {(r["host"], r["open_seq"]): r["n_lines"] for r in spans.collect()} == {k: len(v) for k, v in expect["windows"].items()}

    for r in capped.collect():
        kept[(r["host"], r["open_seq"])] = (r["kept_first"], r["kept_lines"], r["context_truncated"])
    assert kept == expected_kept

    for r in ctx.cap_context(held, params, size).where("role = 'context'").collect():
        trimmed.setdefault((r["host"], r["open_seq"]), []).append(r["seq"])
    wanted = {k: [s for s in v if s >= expected_kept[k][0]] for k, v in expected_own.items()}
    assert {k: sorted(v) for k, v in trimmed.items()} == {k: v for k, v in wanted.items() if v}

    for r in summary.collect():
        ends[(r["host"], r["open_seq"])] = (r["end_reason"], r["lines_after"], r["context_lines"], r["until"])
    assert ends == expect["ends"]

    for r in ctx.context_dedup(held, ranges, size).collect():
        written.setdefault((r["host"], r["open_seq"]), []).append(r["seq"])
    assert {k: sorted(v) for k, v in written.items()} == {k: v for k, v in expect["written"].items() if v}
    for r in ctx.left_out_counts(ranges, size).collect():
        left.setdefault((r["host"], r["open_seq"]), {})[r["held_by_seq"]] = r["n"]
    assert left == {k: v for k, v in expect["left"].items() if v}


@pytest.mark.parametrize("stretch", [1, 7, 256])
def test_whole_windows_meet_their_lines_by_stretches(log, stretch):
    """Windows of many lines are few rows until they meet their lines, and Spark broadcasts them on no guess of their number."""
    hosts = {"h": [(i // 2, "HIT" if i % 40 in (9, 10) else f"line {i}") for i in range(700)], "k": [(0, "HIT"), (500, "x"), (501, "HIT")], "": [(3, "x"), (4, "HIT")]}
    params = CaptureParams(200, 0, 5)
    found, held = run(log(hosts), params)
    spans = stored(ctx.overlapping_context(held, found, params), "spans")
    got = ctx.lookback_context(held, spans, stretch)
    assert got.columns == ["host", "seq", "open_seq", "ts", "t", "is_match", "line", "label", "always"]
    want = sorted(
        (r["host"], r["open_seq"], seq, text)
        for r in found.collect()
        for seq, (at, text) in enumerate(hosts[r["host"]], 1)
        if seq < r["open_seq"] and int(at * S) >= r["open_t"] - params.window_us
    )
    assert len(want) > 5000 and sorted((r["host"], r["open_seq"], r["seq"], r["line"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution()
    assert "Broadcast" not in plan.sparkPlan().toString() + plan.executedPlan().toString()


def test_uncapped_sessions(log):
    labelled = log({"h": [(0, "HIT"), (60, "HIT"), (120.5, "HIT"), (121, "x")], "k": [(3, "HIT")]})
    rows = cap.capture_sessions(cap.match_rows(labelled), CaptureParams(60)).collect()
    got = sorted((r["host"], r["open_seq"], r["last_seq"], r["n_matches"]) for r in rows)
    assert got == [("h", 1, 2, 2), ("h", 3, 3, 1), ("k", 1, 1, 1)]


def test_parameters_are_checked():
    for bad in ({"capture_time": -1}, {"capture_time": 7 * 86400 + 1}, {"capture_time_max": 31 * 86400}, {"line_count_max": -1}):
        with pytest.raises(ValueError):
            CaptureParams(**bad)
