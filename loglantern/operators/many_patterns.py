"""Labels by thousands of patterns, and by many versions of them, in one plan whatever their number.

Every pattern that asks for a literal text, a substring, a piece of a glob, or a part that a regular expression cannot do
without, is filed under that text in one automaton. A line goes through the automaton once; only the patterns whose texts
it holds, and the few that ask for none, are then tried, in rank order up to the first that matches. The pattern set is as large as the
pattern files it comes from and travels to the tasks once.

Texts that are too many for that stay a table. What travels then is of one size whatever their number: their beginnings, with the lengths
of the texts that begin so, and a map of bits that tells most pieces of lines that are no text. The other pieces meet the texts in a join.
"""

from __future__ import annotations

import fnmatch
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as ops
from re import _parser as parser

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored
from .matching import OwnIdentity, PatternSet, PatternVersion, is_own_line, needle_of

FOUND = "label string, always boolean"
KINDS = ("regex", "substring", "glob")  # in rank order
#: Beginnings of texts that travel to the tasks, each with one length; the letters a beginning may have; bits of the map of texts.
BEGINNINGS = 1 << 16
LETTERS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
MAP_BITS = 26


def _runs(parts) -> Iterator[str]:
    """The literal texts that every match of a parsed expression holds."""
    text = ""
    for op, value in parts:
        if op is ops.LITERAL:
            text += chr(value)
            continue
        yield text
        text = ""
        if op is ops.SUBPATTERN and not value[1]:  # a group that sets flags may fold case
            yield from _runs(value[3])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
            yield from _runs(value[2])
        elif op is ops.ATOMIC_GROUP:
            yield from _runs(value)
    yield text


def required_text(kind: str, pattern: str) -> str:
    """The longest text that a line must hold for the pattern to match; '' if it asks for none."""
    if kind == "substring":
        return needle_of(pattern)
    if kind == "glob":
        return max(re.split(r"\[.*?\]|[*?\[]", pattern, flags=re.DOTALL), key=len)
    parsed = parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    return max(_runs(parsed), key=len)


class PatternIndex:
    """A pattern set as an automaton of required texts; built where it is used."""

    def __init__(self, patterns: PatternSet):
        self.ranked, self.tests, filed = patterns.ranked(), {}, {}
        self.order = [(KINDS.index(kind), pattern, rank) for rank, (kind, pattern) in enumerate(self.ranked)]
        self.loose = []
        for rank, (kind, pattern) in enumerate(self.ranked):
            text = required_text(kind, pattern)
            if text:
                filed.setdefault(text, []).append(rank)
            else:
                self.loose.append(rank)
        self.automaton = ahocorasick.Automaton()
        for text, ranks in filed.items():
            self.automaton.add_word(text, ranks)
        if filed:
            self.automaton.make_automaton()

    def _try(self, rank: int, whole: str) -> str | None:
        kind, pattern = self.ranked[rank]
        if kind == "substring":
            return pattern  # its text was found
        if rank not in self.tests:
            self.tests[rank] = re.compile(pattern if kind == "regex" else fnmatch.translate(pattern))
        found = self.tests[rank].search(whole) if kind == "regex" else self.tests[rank].match(whole)
        return None if found is None else found[0] if kind == "regex" else pattern

    def first(self, line: str, held: str | None = None, globs=()) -> str | None:
        """The label of the first pattern in rank order that matches the line. `held` is the first substring pattern of a
        table that the line holds; `globs` are those of a table whose required texts it holds."""
        whole, ranks = line + "\n", set(self.loose)
        if len(self.automaton):
            for _, some in self.automaton.iter(whole):
                ranks.update(some)
        tries = [self.order[rank] for rank in sorted(ranks)]
        if held is not None or len(globs):
            tries += [(KINDS.index("substring"), held, None)] * (held is not None) + [(KINDS.index("glob"), g, None) for g in globs]
            tries.sort(key=lambda one: one[:2])
        for kind, pattern, rank in tries:
            if rank is not None:
                label = self._try(rank, whole)
            else:
                label = pattern if KINDS[kind] == "substring" or _glob_test(pattern).match(whole) else None
            if label is not None:
                return label
        return None


@lru_cache(maxsize=4096)
def _glob_test(pattern: str) -> re.Pattern:
    return re.compile(fnmatch.translate(pattern))


def _filed(texts: DataFrame) -> DataFrame:
    """The patterns of a table of texts, each once, with a text that a line must hold (`key`; '' if there is none), and
    whether that is all a line must hold."""
    text, pattern = F.col("text"), F.concat(F.lit("*"), "text", F.lit("*"))
    plain = (text != "") & ~text.rlike(r"[*?\[]")
    pieces = F.transform(F.split(text, r"(?s)\[!?\]?.*?\]|[*?\[]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("piece")))
    key = F.when(plain, text).otherwise(F.array_max(pieces)["piece"])
    return texts.where(text.isNotNull()).select("text").distinct().select(key.alias("key"), pattern.alias("pattern"), plain.alias("plain"))


def _pieces_of(index):
    """The pieces of each line that may be keys: those that begin and are as long as some key, and are in the map. A line that
    comes again in a batch has none."""

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        starts, marks, shift = index.value
        automaton = ahocorasick.Automaton()
        for start, sizes in starts:
            automaton.add_word(start, (len(start), sizes))
        automaton.make_automaton()
        for lines in batches:
            seen, out = set(), []
            for line in lines:
                found = set()
                if line not in seen:
                    seen.add(line)
                    whole = line + "\n"
                    for end, (n, sizes) in automaton.iter(whole):
                        at = end - n + 1
                        for size in sizes:  # in rising order
                            if at + size > len(whole):
                                break
                            piece = whole[at : at + size]
                            slot = zlib.crc32(piece.encode()) >> shift
                            if marks[slot >> 3] >> (slot & 7) & 1:
                                found.add(piece)
                out.append(list(found))
            yield pd.Series(out)

    return pieces


def _line_key(line: Column) -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(line).alias("_k1"), F.xxhash64(F.lit(1), line).alias("_k2")]


def _held(lines: DataFrame, filed: DataFrame, count: int) -> DataFrame:
    """By line key, the first substring pattern of `filed` that the line holds (`_text`) and the globs whose keys it holds (`_globs`).

    Beginnings have as many letters as keep them, each with each length of its keys, to BEGINNINGS rows. Both sides of the
    join are sorted: pieces are more rows than Spark can see before they are made, so none may be broadcast on its guess."""
    spark = lines.sparkSession
    begins = lambda n: F.substring("key", 1, n)
    kinds = filed.agg(*(F.approx_count_distinct(F.xxhash64(begins(n), F.length("key"))) for n in LETTERS)).first()
    letters = max([LETTERS[0], *(n for n, rows in zip(LETTERS, kinds, strict=True) if rows <= BEGINNINGS)])
    starts = filed.groupBy(begins(letters).alias("start")).agg(F.sort_array(F.collect_set(F.length("key"))).alias("sizes")).collect()
    bits = min(MAP_BITS, max(10, (16 * count).bit_length()))
    slot = F.shiftright(F.crc32("key"), 32 - bits)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = filed.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(mark).alias("mark")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.int64)
    marks[words.column("word").to_numpy()] = words.column("mark").to_numpy()
    index = spark.sparkContext.broadcast(([(r["start"], r["sizes"]) for r in starts], marks.astype("<i8").tobytes(), 32 - bits))
    line = F.col("line")
    pieces = lines.where(line.isNotNull()).select(*_line_key(line), F.explode(_pieces_of(index)(line)).alias("key"))
    found = pieces.join(filed.hint("merge"), "key")
    return found.groupBy("_k1", "_k2").agg(
        F.min(F.when(F.col("plain"), F.col("pattern"))).alias("_text"), F.collect_set(F.when(~F.col("plain"), F.col("pattern"))).alias("_globs")
    )


def _labelled(sets):
    """Label each line by the pattern sets of its version, sets[version]: (patterns, always-notify patterns), and by what
    it holds of a table of texts, where there is one."""

    @F.pandas_udf(FOUND)
    def label(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        built: dict[int, tuple[PatternIndex, PatternIndex]] = {}
        for lines, versions, *held in batches:
            out = []
            for line, version, *more in zip(lines, versions, *held, strict=True):
                if line is None or pd.isna(version):
                    out.append((None, False))
                    continue
                if version not in built:
                    built[version] = tuple(PatternIndex(p) for p in sets.value[int(version)])
                watch, always = built[version]
                found = watch.first(line, *more)
                out.append((found, found is not None and always.first(line) is not None))
            yield pd.DataFrame(out, columns=["label", "always"])

    return label


def label_lines_by_version(
    lines: DataFrame, versions: list[PatternVersion], own: OwnIdentity | None = None, held: tuple[str, ...] = ()
) -> DataFrame:
    """Add label and always as label_lines_versioned does, with any number of versions: a line's version is looked up
    in one list, and its own patterns alone are tried. Of versions that overlap the later in the list holds; a line of none has no label.
    `held` names columns with what a line holds of a table of texts, which rank among those of every version."""
    spark = lines.sparkSession
    sets = spark.sparkContext.broadcast([(v.patterns, v.always) for v in versions])  # as large as the pattern files
    entry = lambda n, v: F.struct(
        F.lit(n).alias("n"), *(F.lit(getattr(v, c)).cast("long").alias(c) for c in ("from_seq", "to_seq", "from_t", "to_t"))
    )
    table = F.array(*(entry(n, v) for n, v in enumerate(versions)))
    t = F.col("t") if "t" in lines.columns else F.lit(None).cast("long")

    def holds(v):
        seq = (F.col("seq") >= v["from_seq"]) & (v["to_seq"].isNull() | (F.col("seq") < v["to_seq"]))
        return seq & (v["from_t"].isNull() | (t >= v["from_t"])) & (v["to_t"].isNull() | (t < v["to_t"]))

    number = F.array_max(F.transform(F.filter(table, holds), lambda v: v["n"])) if versions else F.lit(None).cast("int")
    rows = lines.withColumn("_found", _labelled(sets)(F.col("line"), number, *held))
    seen = F.col("_found.label")
    label = seen if own is None else F.when(seen.isNotNull() & ~is_own_line(F.col("line"), own), seen)
    return rows.withColumn("label", label).withColumn("always", F.coalesce(F.col("label").isNotNull() & F.col("_found.always"), F.lit(False))).drop("_found")


def label_lines_indexed(
    lines: DataFrame, patterns: PatternSet, always: PatternSet = PatternSet(), own: OwnIdentity | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Add label and always as label_lines does, for pattern sets of any size. `texts`, a table with a column `text`, has further
    texts as PatternSet.of takes them, which rank among those of `patterns`: as many as the cluster holds, as they stay a table. Those
    of them alone that ask for no text, such as '?', travel with `patterns`, as every line must be tried by them."""
    rows = lines if "seq" in lines.columns else lines.withColumn("seq", F.lit(0).cast("long"))
    held = ()
    if texts is not None:
        filed = stored(_filed(texts), "texts")
        loose = [r["pattern"] for r in filed.where("key = ''").select("pattern").collect()]
        patterns = PatternSet(patterns.regexes, patterns.globs | frozenset(loose))
        filed = filed.where("key != ''")
        if count := filed.count():
            keys = ("_k1", "_k2")
            rows = rows.select("*", *_line_key(F.col("line"))).join(_held(lines, filed, count), [*keys], "left").drop(*keys)
            rows = rows.withColumn("_globs", F.coalesce("_globs", F.array().cast("array<string>")))
            held = ("_text", "_globs")
    found = label_lines_by_version(rows, [PatternVersion(patterns, always=always)], own, held).drop(*held)
    return found if "seq" in lines.columns else found.drop("seq")
