import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from loglantern.functions.regex import java_regex
from loglantern.operators import matching as m

LINES = [
    "Oct 23 05:44:51 host kernel: nvme nvme0: I/O error, dev sda", "plain text", "", " ", "a\tb", "tail ", "x" * 50,
    "ünïcode Ärger ß ſ K", "١٢٣ digits", "a[1]{2}(3)^$.|?*+\\", "error\r", "aab", "foo-bar_baz", "ab12", "naïve² ½",
    "2024-01-01T00:00:00+00:00 h app[12]: hello", "last word", " nbsp sep\x1cfs", "FOO=bar; foo=BAR", "aXbXc",
    "é combining", "{,3}", "a{,3}", "[]", "^hat", "--", "a&&b", "𝒳 astral",
]
REGEXES = [
    r"I/O error", r"\d+", r"\w+$", r"^\s*$", r"\s", r"\S+\s\S+", r"(?i)ärger", r"(?i)foo=bar", r"(?P<a>a)(?P=a)b", r"(a)\1b",
    r"[[]", r"[]]", r"[^]a]", r"[a-c&&b]", r"a{,3}", r"a{1}", r"\{,", r"a{,2}\}", r"\bfoo\b", r"\Bar", r"word\Z", r"word$", r"error.?$",
    r"(?s)a.b", r"[\w-]+", r"[\d\s]", r"\x41|ä", r"(?:x|y){3,}", r"(?<=a)X", r"(?<!a)X", r"x*?$", r"x*", r"(?i:FOO)-bar",
    r"(a)(?(1)a|b)", r"\t", r"[\s\S]{5}", r"\D+", r"\W", r"[^\w]", r"k", r"(?i)k", r"\$", r"\.", r"a++b", r"(?>a+)b", r"\012|z", r"(?x) a a b",
    r"(?m)^h", r"[\W]", r"(?P<first_name>foo)",
]
GLOBS = [
    "*error*", "*n?me*", "*[ab][0-9]*", "*[!a-z]*", "*[]]*", "*[!]a]*", "*[[]*", "*[", "*[a*", "a*b", "*\n", "*.|?*", "*[z-a]*",
    "*[!z-a]*", "*[a-c-e]*", "*[\\]*", "*^hat*", "*&&*", "??b*", "*[&]*[&]*", "*",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, line string")


def test_regexes_as_python(lines):
    columns = [m.regex_label(F.col("line"), r).alias(f"c{i}") for i, r in enumerate(REGEXES)]
    flags = [m.regex_predicate(F.col("line"), r).alias(f"f{i}") for i, r in enumerate(REGEXES)]
    for row in lines.select("i", *columns, *flags).collect():
        for i, pattern in enumerate(REGEXES):
            found = re.search(pattern, LINES[row["i"]] + "\n")
            assert row[f"c{i}"] == (found[0] if found else None), (pattern, LINES[row["i"]])
            assert row[f"f{i}"] == bool(found), pattern


def test_patterns_without_a_java_form_fall_back():
    odd = {r"[\s\S]{5}", r"(a)(?(1)a|b)", r"\012|z", r"(?x) a a b", r"(?m)^h", r"[\W]"}
    assert {r for r in REGEXES if java_regex(r) is None} == odd


def test_globs_as_fnmatch(lines):
    columns = [m.glob_predicate(F.col("line"), g).alias(f"c{i}") for i, g in enumerate(GLOBS)]
    for row in lines.select("i", *columns).collect():
        for i, glob in enumerate(GLOBS):
            assert row[f"c{i}"] == fnmatch.fnmatchcase(LINES[row["i"]] + "\n", glob), (glob, LINES[row["i"]])


def test_label_order(spark):
    patterns = m.PatternSet.of([r"err\w*", r"b?"], ["disk", "d?sk", "err"])
    rows = spark.createDataFrame([("disk error",), ("disk",), ("dusk",), ("none",)], "line string")
    only = m.PatternSet.of([r"err\w*"], ["disk", "d?sk", "err"])
    got = rows.select(m.first_match(F.col("line"), patterns).alias("a"), m.first_match(F.col("line"), only).alias("b")).collect()
    assert [r["a"] for r in got] == ["", "", "", ""]  # an empty match is a match
    assert [r["b"] for r in got] == ["error", "*disk*", "*d?sk*", None]
    assert m.needle_of("**") is None and m.needle_of("*a*") == "a" and m.needle_of("*a*b*") is None


def test_own_lines(spark):
    own = m.OwnIdentity(("lantern", "lantern.py"), "lantern-self", "/lantern.py")
    ours = [
        "Oct 23 05:44:51 h lantern[12]: HIT", "2024-01-01T00:00:00Z h lantern.py: HIT", "HIT lantern-self", "run /lantern.py HIT",
        "lantern[7]: HIT", "x lantern[7]: HIT",
    ]
    others = [
        "Oct 23 05:44:51 h kernel: /lantern.py HIT", "2024-01-01T00:00:00Z h sshd[1]: user lantern-self HIT",
        "Oct  3 05:44:51 h app[2]: lantern[7]: HIT", "xlantern[7]: HIT", "HIT",
    ]
    rows = spark.createDataFrame([(line,) for line in ours + others], "line string")
    patterns = m.PatternSet.of(texts=["HIT"])
    got = rows.select("line", m.is_own_line(F.col("line"), own).alias("own"), m.matches(F.col("line"), patterns, own).alias("hit"),
                      m.match_label(F.col("line"), patterns, own).alias("label")).collect()
    assert {r["line"] for r in got if r["own"]} == set(ours)
    assert all(r["hit"] != r["own"] and (r["label"] is None) == r["own"] for r in got)


def test_versions(spark):
    rows = spark.createDataFrame([(i, "a b") for i in range(1, 7)], "seq bigint, line string")
    versions = [
        m.PatternVersion(m.PatternSet.of(texts=["a"]), 0, 3),
        m.PatternVersion(m.PatternSet.of(texts=["b"]), 3, 5, m.PatternSet.of(texts=["a"])),
        m.PatternVersion(m.PatternSet.of(texts=["c"]), 5),
    ]
    got = m.label_lines_versioned(rows, versions).orderBy("seq").collect()
    assert [r["label"] for r in got] == ["*a*", "*a*", "*b*", "*b*", None, None]
    assert [r["always"] for r in got] == [False, False, True, True, False, False]
