"""Ageing of what a stream wrote: every row of an ended batch is read once, whatever was compacted and wherever that failed."""

from collections import Counter

import pytest

from loglantern.operators import retention
from loglantern.operators.retention import read_rendered, write_rendered
from loglantern.streaming import store
from loglantern.streaming.batches import MARKERS


class Log:
    """What a stream writes of its texts: each batch a capture of source a in January, of b in February and of c in March 1970."""

    def __init__(self, spark, base):
        self.spark, self.batch, self.output, self.paths = spark, 0, f"{base}/out", set()

    def run(self):
        rows = [(h, self.batch, f"1970-0{i}", f"n{self.batch}.log", part, part + 1, f"{h} {self.batch} {part}") for i, h in enumerate("abc", 1) for part in range(3)]
        df = self.spark.createDataFrame(rows, "host string, open_seq bigint, month string, name string, part int, pos bigint, text string").coalesce(1)
        named = df.select("host", "open_seq", "month", "name").distinct()
        folder = f"{self.output}/texts/batch={self.batch}"
        write_rendered(df.drop("month", "name"), named, folder, "overwrite")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.output}/{MARKERS}/batch={self.batch}")
        self.paths |= {r["path"] for r in read_rendered(self.spark, folder).select("path").collect()}
        self.batch += 1

    def rows(self):
        return Counter((r["path"], r["part"], r["pos"], r["text"]) for r in store.stream_texts(self.spark, self.output).collect())

    def usage(self):
        return {r["month"]: r for r in store.stream_usage(self.spark, self.output).collect()}


@pytest.fixture
def log(spark, tmp_path):
    log = Log(spark, tmp_path)
    for _ in range(2):
        log.run()
    return log


def test_compaction_keeps_every_row_and_path(spark, tmp_path, log):
    before = log.rows()
    assert set(before.values()) == {1}
    assert log.paths == {path for path, *_ in before} and len(log.paths) == 6
    used = log.usage()
    assert {m: (r["entries"], r["compacted"]) for m, r in used.items()} == {m: (2, False) for m in ("1970-01", "1970-02", "1970-03")}
    done = store.compact_stream(spark, log.output, ["1970-01", "1970-02", "2020-01"])
    assert set(done) == {"1970-01", "1970-02"} and sum(done.values()) == sum(n for (p, *_), n in before.items() if "1970-03" not in p)
    assert log.rows() == before
    used = log.usage()
    assert {m: (r["entries"], r["compacted"]) for m, r in used.items()} == {"1970-01": (1, True), "1970-02": (1, True), "1970-03": (2, False)}
    out = tmp_path / "out"
    assert {p.name for p in out.glob("texts/batch=*/month=*")} == {"month=1970-03"}
    # a later batch stands beside the compacted rows, and joins them the next time
    log.run()
    more = log.rows()
    assert before.keys() < more.keys() and set(more.values()) == {1}
    assert log.usage()["1970-01"]["entries"] == 2 and not log.usage()["1970-01"]["compacted"]
    store.compact_stream(spark, log.output, ["1970-01"])
    assert log.rows() == more and log.usage()["1970-01"]["entries"] == 1
    assert len(list(out.glob("aged/generation=*/month=*"))) == 2 and len(list(out.glob("manifest/v=*"))) == 1
    assert store.compact_stream(spark, log.output, ["2020-01"]) == {} and store.compact_stream(spark, log.output, []) == {}


def test_a_plan_and_a_purge(spark, log):
    before = log.rows()
    plan = retention.retention_plan(store.stream_usage(spark, log.output), "1970-04-10", 1, 3)
    assert store.apply_stream_plan(spark, log.output, plan) == {"delete": ["1970-01"], "compact": ["1970-02", "1970-03"]}
    assert log.rows() == Counter({k: n for k, n in before.items() if "1970-01" not in k[0]})
    log.run()  # captures of a deleted month that are closed later are kept
    assert {k[0].split("/month=")[1][:7] for k in log.rows()} == {"1970-01", "1970-02", "1970-03"}
    assert log.usage()["1970-01"]["entries"] == 1
    kept = log.rows()
    purge = retention.purge_plan(store.stream_usage(spark, log.output), 1, "2100-01-01")
    assert store.apply_stream_plan(spark, log.output, purge) == {"delete": ["1970-01"], "compact": []}
    assert log.rows() == Counter({k: n for k, n in kept.items() if "1970-01" not in k[0]})
    store.delete_stream_months(spark, log.output, ["1970-02", "1970-03"])
    assert not log.rows() and not log.usage()
    log.run()
    assert len({k[0] for k in log.rows()}) == 3


def test_failures_lose_and_repeat_nothing(spark, tmp_path, log, monkeypatch):
    before = log.rows()

    def broken(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", broken)  # files written, manifest not
        with pytest.raises(RuntimeError, match="killed"):
            store.compact_stream(spark, log.output, ["1970-01"])
    assert log.rows() == before and not log.usage()["1970-01"]["compacted"]
    (tmp_path / "out" / "manifest" / "v=7").mkdir(parents=True)  # a version that broke off
    with monkeypatch.context() as m:
        m.setattr(store, "sweep", broken)  # manifest written, what it replaces still there
        with pytest.raises(RuntimeError, match="killed"):
            store.compact_stream(spark, log.output, ["1970-01", "1970-03"])
    assert log.rows() == before and log.usage()["1970-01"]["compacted"]
    store.sweep(spark, log.output)
    assert log.rows() == before and len(list((tmp_path / "out").glob("aged/generation=*/month=*"))) == 2
    # a batch that has not ended is neither read, counted nor compacted
    log.run()
    more = log.rows()
    marker = tmp_path / "out" / MARKERS / "batch=2"
    saved = [(p.name, p.read_bytes()) for p in marker.iterdir()]
    store._remove(spark, str(marker))
    assert log.rows() == before
    assert store.compact_stream(spark, log.output, ["1970-01"])["1970-01"] == sum(n for (p, *_), n in before.items() if "1970-01" in p)
    marker.mkdir()
    for name, data in saved:
        (marker / name).write_bytes(data)
    assert log.rows() == more
