"""Labelling lines with ordered pattern sets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import glob_regex, java_regex

# Fixed value: a syslog or RFC 3339 line prefix; group 1 is the identifier.
LINE_PREFIX = r"\A(?:\S+ +\d{1,2} \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\S+) \S+ (\S+?)(?:\[\d+\])?: "
GLOB_MARKS = frozenset("*?[")


@dataclass(frozen=True)
class PatternSet:
    """Regular expressions, and whole-line globs (text files give '*text*')."""

    regexes: frozenset[str] = frozenset()
    globs: frozenset[str] = frozenset()

    @classmethod
    def of(cls, regexes=(), texts=()) -> PatternSet:
        return cls(frozenset(regexes), frozenset(f"*{t}*" for t in texts))

    def __bool__(self) -> bool:
        return bool(self.regexes or self.globs)

    def ranked(self) -> list[tuple[str, str]]:
        """(kind, pattern) in the order that decides a label: regexes, then plain
        substrings, then globs, each sorted."""
        plain = [g for g in sorted(self.globs) if needle_of(g) is not None]
        other = [g for g in sorted(self.globs) if needle_of(g) is None]
        return (
            [("regex", r) for r in sorted(self.regexes)]
            + [("substring", g) for g in plain]
            + [("glob", g) for g in other]
        )


@dataclass(frozen=True)
class OwnIdentity:
    """How lines this job's own logging wrote are recognised."""

    idents: tuple[str, ...] = ("loglantern",)
    marker: str = "loglantern-self"
    needle: str = "/loglantern.py"


@dataclass(frozen=True)
class PatternVersion:
    """A pattern set that holds for lines from_seq <= seq < to_seq (None: open end) and, where given, of times
    from_t <= t < to_t in microseconds: a reload is one moment, and another line number in each source."""

    patterns: PatternSet
    from_seq: int = 0
    to_seq: int | None = None
    always: PatternSet = field(default_factory=PatternSet)
    from_t: int | None = None
    to_t: int | None = None


def needle_of(glob: str) -> str | None:
    """The literal text of a '*text*' glob without wildcards inside, else None."""
    inner = glob[1:-1]
    literal = len(glob) > 2 and glob[0] == "*" and glob[-1] == "*" and not GLOB_MARKS & set(inner)
    return inner if literal else None


def substring_predicate(line: Column, needle: str) -> Column:
    return line.contains(F.lit(needle))


def glob_predicate(line: Column, glob: str) -> Column:
    """The line, as read with its line end, matches the whole glob."""
    return F.concat(line, F.lit("\n")).rlike(glob_regex(glob))


def _python_search(pattern: str):
    compiled = re.compile(pattern)

    @F.pandas_udf("string")
    def search(lines: pd.Series) -> pd.Series:
        found = (None if line is None else compiled.search(line) for line in lines)
        return pd.Series([None if m is None else m[0] for m in found], dtype=object)

    return search


def regex_label(line: Column, pattern: str, earlier: list[Column] | None = None) -> Column:
    """The first text in the line that the Python pattern matches ('' is a match), or null. A pattern that only Python
    can search sees the lines alone that `earlier` labels leave."""
    whole = F.concat(line, F.lit("\n"))
    java = java_regex(pattern)
    if java is None:
        return _python_search(pattern)(F.when(F.coalesce(*earlier).isNull(), whole) if earlier else whole)
    return F.when(whole.rlike(java), F.regexp_extract(whole, java, 0))


def regex_predicate(line: Column, pattern: str) -> Column:
    java = java_regex(pattern)
    if java is None:
        return regex_label(line, pattern).isNotNull()
    return F.concat(line, F.lit("\n")).rlike(java)


def first_match(line: Column, patterns: PatternSet) -> Column:
    """Label of the first matching pattern in rank order, or null."""
    labels = []
    for kind, pattern in patterns.ranked():
        if kind == "regex":
            labels.append(regex_label(line, pattern, list(labels)))
        elif kind == "substring":
            labels.append(F.when(substring_predicate(line, needle_of(pattern)), F.lit(pattern)))
        else:
            labels.append(F.when(glob_predicate(line, pattern), F.lit(pattern)))
    return F.coalesce(*labels) if labels else F.lit(None).cast("string")


def any_match(line: Column, patterns: PatternSet) -> Column:
    """Whether any pattern matches; cheap substring tests come first."""
    tests = {"substring": [], "glob": [], "regex": []}
    for kind, pattern in patterns.ranked():
        if kind == "regex":
            tests[kind].append(regex_predicate(line, pattern))
        elif kind == "substring":
            tests[kind].append(substring_predicate(line, needle_of(pattern)))
        else:
            tests[kind].append(glob_predicate(line, pattern))
    ordered = [test for kind in tests.values() for test in kind]
    return reduce(lambda a, b: a | b, ordered) if ordered else F.lit(False)


def is_own_line(line: Column, own: OwnIdentity) -> Column:
    """A line of ours: by its identifier when it has a log prefix, else by a marker,
    our file name, or 'ident[pid]:' anywhere in it."""
    prefix = java_regex(LINE_PREFIX)
    named = "|".join(re.escape(i) for i in own.idents)
    loose = (
        line.contains(own.marker)
        | line.contains(own.needle)
        | regex_predicate(line, rf"(?:^|\s)(?:{named})\[\d+\]:")
    )
    ident = F.regexp_extract(line, prefix, 1)  # '' only without a prefix
    return F.when(ident != "", ident.isin(*own.idents)).otherwise(loose)


def match_label(line: Column, patterns: PatternSet, own: OwnIdentity | None = None) -> Column:
    """first_match, but null on our own lines (tested only on lines that match)."""
    label = first_match(line, patterns)
    if own is None:
        return label
    return F.when(label.isNotNull() & ~is_own_line(line, own), label)


def matches(line: Column, patterns: PatternSet, own: OwnIdentity | None = None) -> Column:
    found = any_match(line, patterns)
    return found if own is None else found & ~is_own_line(line, own)


def always_notify_match(line: Column, label: Column, always: PatternSet) -> Column:
    """On a line that matched, whether the always-notify patterns match too."""
    if not always:
        return F.lit(False)
    return F.coalesce(label.isNotNull() & any_match(line, always), F.lit(False))


def label_lines(
    lines: DataFrame, patterns: PatternSet, always: PatternSet = PatternSet(), own: OwnIdentity | None = None
) -> DataFrame:
    """Add label (null: no match) and always. Write the result once: every later step
    reads the label instead of matching again."""
    labelled = lines.withColumn("label", match_label(F.col("line"), patterns, own))
    return labelled.withColumn("always", always_notify_match(F.col("line"), F.col("label"), always))


def label_lines_versioned(
    lines: DataFrame, versions: list[PatternVersion], own: OwnIdentity | None = None
) -> DataFrame:
    """label_lines with patterns that changed on the way: each line uses the version its seq (and t) falls in."""
    label, always = F.lit(None).cast("string"), F.lit(False)
    for version in versions:
        holds = F.col("seq") >= version.from_seq
        if version.to_seq is not None:
            holds = holds & (F.col("seq") < version.to_seq)
        if version.from_t is not None:
            holds = holds & (F.col("t") >= version.from_t)
        if version.to_t is not None:
            holds = holds & (F.col("t") < version.to_t)
        found = match_label(F.col("line"), version.patterns, own)
        label = F.when(holds, found).otherwise(label)
        always = F.when(holds, always_notify_match(F.col("line"), found, version.always)).otherwise(always)
    return lines.withColumn("label", label).withColumn("always", always)
