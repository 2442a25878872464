"""Pattern files as a table and as pattern sets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.matching import PatternSet, needle_of

def pattern_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Folders give their pattern files in name order, subfolders left out; a path to a file is taken as it is."""
    found = []
    for path in paths:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            continue
        if not fs.getFileStatus(fs_path).isDirectory():
            found.append(path)
            continue
        names = [(s.getPath().getName(), s) for s in fs.listStatus(fs_path) if s.isFile()]
        found += [s.getPath().toString() for name, s in sorted(names, key=lambda n: n[0]) if is_pattern_name(name)]
    return found


def is_pattern_name(name: str) -> bool:
    """Not hidden, no backup, no README."""
    return not re.fullmatch(r"|\..*|.*~|.*\.bak|(?i:readme(\..*)?)", name, re.DOTALL)


def load_patterns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """kind, pattern, needle, rank of every pattern. Lines of *.regex files are Python regular
    expressions, invalid ones left out; other files hold texts found anywhere in a line. A
    file that is not UTF-8 is skipped whole; blank lines and # comments are skipped."""
    files = pattern_files(spark, paths)
    schema = "kind string, pattern string, needle string, rank int"
    if not files:
        return spark.createDataFrame([], schema)
    content = spark.read.format("binaryFile").load(files).select("path", F.col("content").cast("string").alias("text"))
    row = F.explode(F.split(F.regexp_replace("text", r"\A\x{FEFF}", ""), r"\r\n|\r|\n"))
    rows = (
        content.where(F.is_valid_utf8("text"))
        .select(F.col("path").endswith(".regex").alias("is_regex"), row.alias("pattern"))
        .withColumn("pattern", strip(F.col("pattern")))
        .where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
        .distinct()
    )
    ranked = pattern_set(rows).ranked()
    return spark.createDataFrame(
        [(kind, p, needle_of(p) if kind == "substring" else None, rank) for rank, (kind, p) in enumerate(ranked)], schema
    )


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def pattern_set(rows: DataFrame) -> PatternSet:
    """The pattern set of (is_regex, pattern) rows or of a load_patterns table."""
    if "kind" in rows.columns:
        listed = [(r["kind"] == "regex", r["pattern"]) for r in rows.select("kind", "pattern").collect()]
        return PatternSet(frozenset(p for rx, p in listed if rx), frozenset(p for rx, p in listed if not rx))
    listed = [(r["is_regex"], r["pattern"]) for r in rows.collect()]
    return PatternSet.of([p for rx, p in listed if rx and _valid(p)], [p for rx, p in listed if not rx])


def pattern_sets(spark: SparkSession, watch: list[str], always: list[str] = ()) -> tuple[PatternSet, PatternSet]:
    """(watch, always-notify) sets; ValueError when no watch pattern loads."""
    found = pattern_set(load_patterns(spark, list(watch)))
    if not found:
        raise ValueError(f"no usable patterns in {watch}")
    return found, pattern_set(load_patterns(spark, list(always))) if always else PatternSet()
