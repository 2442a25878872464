"""Indexed labels against the column expressions, and the texts that patterns cannot do without."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loglantern.operators import many_patterns as many
from loglantern.operators.matching import OwnIdentity, PatternSet, PatternVersion, label_lines, label_lines_versioned
from loglantern.plans import catalog

WORDS = ["disk", "nvme0", "I/O", "error", "link", "up", "down", "é", "eth1", "reset", "ok", "[1]", "*"]


@pytest.mark.parametrize("kind,pattern,text", [
    ("substring", "*disk error*", "disk error"), ("glob", "*d?sk [ab]x[!c]yyyy*", "yyyy"), ("glob", "*?*", ""), ("glob", "a[bc", "bc"),
    ("regex", r"I/O error.*sd[a-z]", "I/O error"), ("regex", r"(?:abc)+d?ef", "abc"), ("regex", r"x|yy", ""), ("regex", r"(?i)abc", ""),
    ("regex", r"(abc){0,2}", ""), ("regex", r"a(?i:bcd)e", "a"), ("regex", r"\d+", ""), ("regex", r"(?P<n>link) down", "link"), ("regex", "", ""),
])
def test_required_text(kind, pattern, text):
    assert many.required_text(kind, pattern) in (text, " down" if text == "link" else text)


def some_patterns(rng, n):
    regexes = [rng.choice([rf"{rng.choice(WORDS[:6])}.*\d", r"(?i)ETH\d", r"ok$", r"reset|down", rf"(?:{rng.choice(WORDS[:6])} )+up", r"^$"]) for _ in range(n)]
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)] + ["d?sk", "[el]ink*o", "nvme[!1]"]
    return PatternSet.of(regexes, texts)


def test_same_labels_as_columns(spark):
    rng = random.Random(5)
    lines = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 7)))) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame(lines, "seq bigint, line string")
    own = OwnIdentity(idents=("eth",), marker="reset up", needle="/none")
    for n in (0, 2, 12):
        patterns, always = (some_patterns(rng, n) if n else PatternSet() for _ in range(2))
        rows = lambda d: sorted((r["seq"], r["label"], r["always"]) for r in d.where("line IS NOT NULL").collect())
        assert rows(many.label_lines_indexed(df, patterns, always, own)) == rows(label_lines(df, patterns, always, own))


def test_many_versions(spark):
    rng = random.Random(8)
    lines = [(i, i * 10, " ".join(rng.choices(WORDS, k=5))) for i in range(300)]
    df = spark.createDataFrame(lines, "seq bigint, t bigint, line string")
    versions = [PatternVersion(some_patterns(rng, 2), 30 * i, 30 * i + 40, some_patterns(rng, 1)) for i in range(9)]
    versions += [PatternVersion(some_patterns(rng, 1), from_t=500, to_t=900)]
    rows = lambda d: sorted((r["seq"], r["label"], r["always"]) for r in d.collect())
    assert rows(many.label_lines_by_version(df, versions)) == rows(label_lines_versioned(df, versions))
    hundred = [PatternVersion(PatternSet.of(texts=[WORDS[i % 10]]), 3 * i, 3 * i + 3) for i in range(100)]
    got = {r["seq"]: r["label"] for r in many.label_lines_by_version(df, hundred).collect()}
    assert got == {s: (f"*{WORDS[s // 3 % 10]}*" if WORDS[s // 3 % 10] in line else None) for s, _, line in lines}


def test_thousands_of_patterns_are_one_plan(spark):
    texts = [f"needle {i} end" for i in range(6000)]
    regexes = [rf"rx{i}-\d+" for i in range(500)]
    lines = [(i, f"a needle {i} end b" if i % 2 else f"rx{i}-77 needle {i} end") for i in range(0, 6000, 37)]
    df = spark.createDataFrame(lines, "seq bigint, line string")
    found = many.label_lines_indexed(df, PatternSet.of(regexes, texts))
    want = {i: (m[0] if (m := re.search(r"rx\d+-\d+", line)) and i < 500 else f"*needle {i} end*") for i, line in lines}
    assert {r["seq"]: r["label"] for r in found.collect()} == want
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert found.select(F.col("always")).distinct().collect()[0][0] is False


@pytest.mark.parametrize("beginnings,bits", [(1, 10), (40, 12), (1 << 16, 26)])
def test_texts_of_a_table(spark, monkeypatch, beginnings, bits):
    monkeypatch.setattr(many, "BEGINNINGS", beginnings)
    monkeypatch.setattr(many, "MAP_BITS", bits)
    rng = random.Random(11)
    lines = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 7)))) for i in range(300)] + [(i, "disk error link") for i in range(300, 340)]
    df = spark.createDataFrame([*lines, (1000, None)], "seq bigint, line string")
    own = OwnIdentity(idents=("eth",), marker="reset up", needle="/none")
    for n in (1, 5, 60):
        texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(n)] + ["d?sk error", "[el]ink*o", "nvme[!1]", "I/O*up"][:n]
        texts += ["rror l", "disk", "disk e", "é e", " "] * (n > 1) + ["?" * 30, "not there"]
        patterns, always = some_patterns(rng, 2), some_patterns(rng, 1)
        table = spark.createDataFrame([(t,) for t in [*texts, *texts[:3], None]], "text string")
        got = many.label_lines_indexed(df, patterns, always, own, table)
        assert got.columns == ["seq", "line", "label", "always"]
        want = label_lines(df, PatternSet(patterns.regexes, patterns.globs | PatternSet.of(texts=texts).globs), always, own)
        rows = lambda d: sorted((r["seq"], r["label"], r["always"]) for r in d.where("line IS NOT NULL").collect())
        assert rows(got) == rows(want)
        assert got.where("line IS NULL").select("label", "always").collect() == [(None, False)]


@pytest.mark.parametrize("texts", [[], ["", "up"], ["?"]])
def test_tables_of_few_texts(spark, texts):
    df = spark.createDataFrame([(1, "link up"), (2, ""), (2, "down"), (None, "link up")], "seq bigint, line string")
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = lambda d: sorted((r["line"], str(r["label"])) for r in d.collect())
    assert rows(many.label_lines_indexed(df.drop("seq"), PatternSet(), texts=table)) == rows(label_lines(df, PatternSet.of(texts=texts)))


def test_query_keeps_its_texts_a_table(spark, tmp_path, monkeypatch):
    """The driver gets a number of rows that does not follow that of the texts."""
    users = [u for u in range(60_000) if u % 3]
    events = spark.createDataFrame([(2 * i + j, 1_700_000_000 + i, u, "click", "p") for i, u in enumerate(users[:9000]) for j in (0, 1)],
                                   "event_id bigint, ts bigint, user_id bigint, event_type string, props string")
    events.withColumn("ts", F.timestamp_seconds("ts")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(many, "BEGINNINGS", 300)
    most = [0]
    collect = type(events).collect

    def counted(df):
        rows = collect(df)
        most[0] = max(most[0], len(rows))
        return rows

    monkeypatch.setattr(type(events), "collect", counted)
    found = catalog.first_match_many(spark, str(tmp_path))
    assert most[0] <= 400
    rows = collect(found)
    needles = {f"click user {u} p" for u in users[:9000]}
    assert len(rows) == 18_000 and {r["label"] for r in rows} == {f"*{n}*" for n in needles} and not any(r["always"] for r in rows)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
