import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglantern.operators.matching import PatternSet
from loglantern.sources import journal, lines, patterns


def test_odd_text(spark, tmp_path):
    first = "one\ntwo \xff".encode("latin-1") + "\n\r\n  \t \n three\rfour\n\x1c\n last without end".encode()
    (tmp_path / "a.log").write_bytes(first)
    (tmp_path / "b.log").write_bytes("b1\n\nb2\n".encode())
    got = lines.read_log_lines(spark, str(tmp_path), F.regexp_extract("_metadata.file_path", r"([ab])\.log", 1))
    rows = sorted((r["host"], r["seq"], r["line"]) for r in got.collect())
    assert rows == [
        ("a", 1, "one"), ("a", 2, "two �"), ("a", 3, " three\rfour"), ("a", 4, " last without end"), ("b", 1, "b1"), ("b", 2, "b2"),
    ]


def test_long_lines_come_in_pieces(spark):
    df = spark.createDataFrame([("abcdefg",), ("abcdef",), ("",)], "line string")
    got = lines.split_pieces(df, limit=3).collect()
    assert [(r["piece"], r["line"]) for r in got] == [(0, "abc"), (1, "def"), (2, "g"), (0, "abc"), (1, "def"), (0, "")]


def test_tail_and_time(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 6)] + [("b", 1)], "host string, seq bigint")
    assert sorted(tuple(r) for r in lines.tail_start(df, last=2).collect()) == [("a", 4), ("a", 5), ("b", 1)]
    assert sorted(tuple(r) for r in lines.tail_start(df, first=4).collect()) == [("a", 4), ("a", 5)]
    times = spark.sql("SELECT timestamp_seconds(s) AS s, timestamp_seconds(100) AS r FROM VALUES (97.9), (98), (99) AS t(s)")
    got = times.select(F.unix_seconds(lines.line_time(F.col("s"), F.col("r"))).alias("t")).collect()
    assert [r["t"] for r in got] == [97, 100, 100]


def test_number_lines_keeps_lines_without_a_source(spark):
    df = spark.createDataFrame([(None, 2, "b"), ("a", 1, "x"), (None, 1, "a"), (None, 3, " ")], "host string, at bigint, line string")
    got = sorted((r["host"], r["seq"], r["line"]) for r in lines.number_lines(df, ["at"]).collect())
    assert got == [("", 1, "a"), ("", 2, "b"), ("a", 1, "x")]


def test_steady_time(spark):
    rows = [("a", 1, 5), ("a", 2, 3), ("a", 3, 9), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "host string, seq bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["host"], r["seq"]): r["t"] // 10**6 for r in lines.steady_time(df).collect()}
    assert got == {("a", 1): 5, ("a", 2): 5, ("a", 3): 9, ("b", 1): 1}


def record(**fields):
    out = b""
    for name, value in fields.items():
        if isinstance(value, bytes):
            out += name.encode() + b"\n" + len(value).to_bytes(8, "little") + value + b"\n"
        else:
            out += f"{name}={value}\n".encode()
    return out + b"\n"


def test_journal_export(spark, tmp_path):
    usec = 1_700_000_000_000_000
    data = (
        record(__CURSOR="c1", __REALTIME_TIMESTAMP=usec, MESSAGE=b"one\n\n two", SYSLOG_IDENTIFIER="app", _PID="7", _HOSTNAME="h", _X=b"\n\n\n")
        + record(__CURSOR="c2", __REALTIME_TIMESTAMP="x", MESSAGE="no time")
        + record(__REALTIME_TIMESTAMP=usec, MESSAGE="no cursor")
        + record(__CURSOR="c3", __REALTIME_TIMESTAMP=usec + 10**6, _SOURCE_REALTIME_TIMESTAMP=usec - 10**6, MESSAGE="x=y", _COMM="sh", SYSLOG_PID="9")
        + record(__CURSOR="c4", __REALTIME_TIMESTAMP=usec, MESSAGE="first", _BAD_="") .replace(b"\n\n", b"\nMESSAGE=last wins\nnot a field\n\n")
        + record(__CURSOR="c5", __REALTIME_TIMESTAMP=usec, _SOURCE_REALTIME_TIMESTAMP="9" * 30)
        + b"__CURSOR=c6\n__REALTIME_TIMESTAMP=%d\nMESSAGE=cut" % usec
    )
    (tmp_path / "x.export").write_bytes(data)
    entries = journal.read_journal_export(spark, str(tmp_path)).cache()
    assert [r["cursor"] for r in entries.orderBy("place").collect()] == ["c1", "c3", "c4", "c5"]
    got = [(r["cursor"], r["part"], r["line"]) for r in journal.journal_to_lines(entries).orderBy("place", "part").collect()]
    stamp = "2023-11-14T22:13:20+00:00"
    assert got == [
        ("c1", 0, f"{stamp} h app[7]: one"), ("c1", 2, " " * len(f"{stamp} h app[7]: ") + " two"),
        ("c3", 0, "2023-11-14T22:13:19+00:00 sh[9]: x=y"), ("c4", 0, f"{stamp} unknown: last wins"),
    ]


def test_one_export_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    """Stretches of every length give what one stretch gives; a binary field that holds whole records is not cut."""
    rng = random.Random(6)
    usec, data, want = 1_700_000_000_000_000, b"", []
    fake = record(__CURSOR="fake", __REALTIME_TIMESTAMP=1, MESSAGE="never") * 3
    for i in range(120):
        message = rng.choice([b"plain", b"two\nlines", fake, b"\n\n" + fake + b"MESSAGE\n", b"x" * rng.randint(0, 3000), b"\n" * 10])
        data += record(__CURSOR=f"c{i}", __REALTIME_TIMESTAMP=usec + i, _X=fake[: rng.randint(0, len(fake))], MESSAGE=message, _HOSTNAME="h")
        want.append((f"c{i}", usec + i, message[: journal.FIELD_MAX].decode()))
    (tmp_path / "one.export").write_bytes(data + b"__CURSOR=cut\n__REALTIME_TIMESTAMP=1\nMESSAGE\n" + (900).to_bytes(8, "little") + b"short\n\n")
    for every in (30_000, 1 << 20):
        found = journal.read_journal_export(spark, str(tmp_path), every)
        rows = sorted(found.collect(), key=lambda r: r["place"])
        assert [(r["cursor"], r["stored_us"], r["message"]) for r in rows] == want
    for every in (1, 700, 5000):
        cuts = journal._cut_points(every)([pd.DataFrame({"path": [f"{tmp_path}/one.export"]})])
        rows = pd.concat(journal._decode(cuts))
        assert list(zip(rows["cursor"], rows["stored"].astype(int), rows["message"], strict=True)) == want
    cuts = [r for batch in journal._cut_points(5000)([pd.DataFrame({"path": [f"file:{tmp_path}/one.export"]})]) for r in batch.itertuples()]
    assert len(cuts) > 3 and all(a.stop == b.start for a, b in zip(cuts, cuts[1:], strict=False))
    parts = journal.read_journal_export(spark, str(tmp_path), 30_000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    # values longer than is kept of a field, as text and as bytes
    monkeypatch.setattr(journal, "FIELD_MAX", 50)
    text = record(__CURSOR="c" * 80, __REALTIME_TIMESTAMP=1, MESSAGE=b"y" * 200) + record(__CURSOR="d", __REALTIME_TIMESTAMP=2, MESSAGE="z" * 90)
    (tmp_path / "long").write_bytes(text)
    batch = [pd.DataFrame({"path": [f"{tmp_path}/long"], "start": [0], "stop": [None]})]
    rows = pd.concat(journal._decode(batch))
    assert rows["message"].tolist() == ["y" * 50, "z" * 42] and rows["cursor"].tolist() == ["c" * 41, "d"]


@pytest.fixture
def entries(spark):
    rows = [("j", i, f"c{i}", stored) for i, stored in enumerate([10, 50, 20, 60, 90, 80, 100, 130, 140], 1)]
    return spark.createDataFrame(rows, "host string, seq bigint, cursor string, stored bigint")


def resumed(entries, position, now, back=40, most=3600):
    got = journal.resume_slice(entries, position, now, back, most, tail=2, any_cursor=True, size=3).orderBy("seq").collect()
    return [(r["seq"], r["role"], r["time"]) for r in got]


def test_resume(entries):
    P = journal.Position
    found = resumed(entries, P("c7", 100), 150)
    assert found == [(4, "context", 60), (5, "context", 80), (6, "context", 80), (7, "context", 100), (8, "match", 130), (9, "match", 140)]
    assert resumed(entries, P("gone", 100), 141) == [(s, "match", t) for s, t in [(4, 60), (5, 90), (6, 80), (7, 100), (8, 130), (9, 141)]]
    assert resumed(entries, P("c3", 20), 200, most=90) == [(8, "match", 130), (9, "match", 140)]
    assert resumed(entries, None, 200) == [(8, "match", 130), (9, "match", 140)]
    assert resumed(entries, P("gone", 300), 200) == [(8, "match", 130), (9, "match", 140)]
    saved = journal.position_of(entries).first()
    assert (saved["cursor"], saved["time"]) == ("c9", 140)


def test_pattern_files(spark, tmp_path):
    folder = tmp_path / "patterns"
    folder.mkdir()
    (folder / "a.txt").write_bytes("﻿first\n# no\n\n  two words  \r\nfirst\n".encode())
    (folder / "b.regex").write_text("err\\d+\n(bad\n")
    (folder / "keep.fnmatch").write_text("d?sk\n")
    (folder / "latin.txt").write_bytes(b"caf\xe9\n")
    for name in (".hidden", "README", "readme.md", "x~", "x.bak"):
        (folder / name).write_text("never\n")
    (folder / "sub").mkdir()
    (folder / "sub" / "c.txt").write_text("never\n")
    (tmp_path / "alone.bak").write_text("taken\n")
    table = patterns.load_patterns(spark, [str(folder), str(tmp_path / "alone.bak"), str(tmp_path / "missing")])
    assert [(r["kind"], r["pattern"], r["needle"], r["rank"]) for r in table.orderBy("rank").collect()] == [
        ("regex", "err\\d+", None, 0), ("substring", "*first*", "first", 1), ("substring", "*taken*", "taken", 2),
        ("substring", "*two words*", "two words", 3), ("glob", "*d?sk*", None, 4),
    ]
    watch, always = patterns.pattern_sets(spark, [str(folder)], [str(tmp_path / "missing")])
    assert watch.regexes == {"err\\d+"} and not always and isinstance(always, PatternSet)
    with pytest.raises(ValueError):
        patterns.pattern_sets(spark, [str(tmp_path / "missing")])
