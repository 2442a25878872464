"""Headline timings: one JSON line.

Every entry runs over all of $BENCH_SF_DIR's events (default sf0.1) once to warm up and
once for the time. `whole_path` numbers, labels, cuts, collects, and leaves out what is held, from raw rows. Entries
named in `prepared` are operator times: they read tables that stand before the clock starts. The `replicated_*`
entries run the whole path, numbering included, over copies of the events, $BENCH_COPIES of them (default 100), each
30 days after the last; the rate is over all of them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loglantern.operators import captures as cap  # noqa: E402
from loglantern.operators import context as ctx  # noqa: E402
from loglantern.operators.matching import label_lines  # noqa: E402
from loglantern.plans import catalog  # noqa: E402
from loglantern.plans.scratch import drop_scratch, scratch_scope, stored  # noqa: E402
from loglantern.sources.lines import number_lines  # noqa: E402
from loglantern.sources.tables import ALWAYS, OWN, PARAMS, WATCH, log_lines, raw_lines  # noqa: E402

MONTH_US = 30 * 86400 * 1_000_000


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def copies_of(spark: SparkSession, sf_dir: str, copies: int):
    rows = raw_lines(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn("t", F.col("t") + F.col("copy") * MONTH_US).withColumn("ts", F.timestamp_micros("t"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("BENCH_COPIES", "100"))
    spark = session()
    lines = log_lines(spark, sf_dir).select("host", "seq", "ts", "t", "line")
    labelled = catalog.labelled_lines(spark, sf_dir)
    catalog.ranges(spark, sf_dir)
    catalog.placed(spark, sf_dir)

    def captures_of(lines):
        marked = stored(label_lines(lines, WATCH, ALWAYS, OWN), "bench")
        found, held = cap.captured_lines(marked, PARAMS)
        return marked, found, held

    def left_out(marked, found, held):
        capped = ctx.context_windows(held, PARAMS)
        told = cap.capture_summary(held, cap.source_ends(marked), PARAMS)
        ranges = stored(ctx.held_ranges(capped, told), "bench")
        run(ctx.context_dedup(held, ranges))
        run(ctx.left_out_counts(ranges))

    def engine():
        marked = stored(label_lines(lines, WATCH, ALWAYS, OWN), "bench")
        found = stored(cap.find_captures(cap.match_rows(marked), PARAMS), "bench")
        run(cap.capture_lines(marked, found, PARAMS))

    def whole_path():
        with scratch_scope(spark):
            left_out(*captures_of(number_lines(raw_lines(spark, sf_dir), ["t", "event_id"])))

    work = {
        "number_lines": lambda: run(number_lines(raw_lines(spark, sf_dir), ["t", "event_id"])),
        "label_lines": lambda: run(label_lines(lines, WATCH, ALWAYS, OWN)),
        "match_capture": engine,
        "whole_path": whole_path,
        "capture_sessions": lambda: run(cap.capture_sessions(cap.match_rows(labelled), PARAMS)),
    }
    prepared = (
        "capture_sessions_capped", "capture_members", "overlapping_context", "context_byte_cap", "context_dedup",
        "left_out_counts", "capture_summary", "render_capture", "excerpt_marks", "excerpt_around_match",
        "route_capture", "first_match", "slugify", "parse_verdict",
    )
    for name in prepared:
        work[name] = lambda q=catalog.QUERIES[name]: run(q(spark, sf_dir))
    seconds = {}
    for name, job in work.items():
        job()
        seconds[name] = timed(job)

    count = lines.count()
    large = {}
    if copies:
        many = stored(copies_of(spark, sf_dir, copies), "many").select("host", "event_id", "ts", "t", "line")
        total = count * copies
        steps = {}

        def number():
            steps["lines"] = stored(number_lines(many, ["t", "event_id"]), "many_lines")

        def label():
            steps["labelled"] = stored(label_lines(steps["lines"], WATCH, ALWAYS, OWN), "many_labelled")

        def captures():
            steps["captures"] = stored(cap.find_captures(cap.match_rows(steps["labelled"]), PARAMS), "many_captures")

        def held():
            steps["held"] = stored(cap.capture_lines(steps["labelled"], steps["captures"], PARAMS), "many_held")

        def dedup():
            left_out(steps["labelled"], steps["captures"], steps["held"])

        order = (number, label, captures, held, dedup)
        for step in order:
            large[f"replicated_{step.__name__}"] = timed(step)
        large["replicated_lines"] = total
        path = sum(large[f"replicated_{s.__name__}"] for s in order)
        large["replicated_lines_per_sec"] = round(total / path)
    drop_scratch(spark)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "lines": count,
        "lines_per_sec": round(count / seconds["whole_path"]), "prepared": sorted(prepared), **large,
    }))


if __name__ == "__main__":
    main()
