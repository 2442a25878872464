"""Passages that repeat, by seed and extend.

Seeds: of the hashes of all 12-word stretches in a window of words, winnowing picks the least (the last of
equals). The pick depends on the window alone, so equal windows pick equal anchors at the same place in
them, and an anchor's run is the windows next to each other that pick it. Occurrences are joined on
their anchors; an anchor met once ends there. Extension goes both ways from the anchor, to the ends of
the run: occurrences whose whole runs are equal form one class and need no pairs. Only where an
anchor has several classes, one occurrence of each is extended window by window, and windows
are counted over the classes. Windows that occur twice make up the maximal repeats, and their words go.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern.llm.tables import table
from loglantern.llm.words import blocks, running, signed, stretch, taken
from loglantern.plans.scratch import stored

MIN_WORDS = 35
SEED_WORDS = 12


def _picked(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each place, where the least of the next `span` values is, the last of equals; by doubling."""
    best, width = np.arange(len(seeds)), 1

    def later(first, by):
        n = len(first) - by
        x, y = first[:n], first[by:]
        return np.where(seeds[y] <= seeds[x], y, x)

    while width * 2 <= span:
        best = later(best, width)
        width *= 2
    if width < span:
        n = len(seeds) - span + 1
        x, y = best[:n], best[span - width : span - width + n]
        best = np.where(seeds[y] <= seeds[x], y, x)
    return best


def _anchors(words: int, seed: int):
    """The runs of each text: the anchor's hash, the hash of the run's words with the anchor's place in it, where it starts and its windows."""

    def rows(batches):
        for batch, texts in blocks(batches):
            total = running(texts.hashes())
            n_all, reach = len(texts.start), words - seed + 1
            if n_all < words:
                continue
            at = np.arange(n_all - seed + 1)
            picked = _picked(stretch(total, at, at + seed), reach)  # a place for each window of all words in a row
            owner = texts.text_of()
            start = np.flatnonzero(owner[: len(picked)] == owner[words - 1 :])
            if not len(start):
                continue
            anchor = picked[start]
            first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[start[1:]] != owner[start[:-1]]))))
            n = np.diff(np.concatenate((first, [len(start)])))
            begin, anchor = start[first], anchor[first]
            lead = anchor - begin
            run = stretch(total, begin, begin + n + words - 1) ^ (lead.astype(np.uint64) << np.uint64(48))
            own = owner[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    taken(batch, "doc_id", own), taken(batch, "text_hash", own), signed(stretch(total, anchor, anchor + seed)), signed(run),
                    pa.array((begin - texts.first[own]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ],
                names=["doc_id", "text_hash", "anchor", "run", "start", "n"],
            )

    return rows


def _windows(words: int):
    """Each window of the given runs of each text."""

    def rows(batches):
        for batch, texts in blocks(batches):
            total = running(texts.hashes())
            runs = batch.column(batch.schema.get_field_index("runs"))
            owner = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            start, n, many = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "many"))
            begin = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(texts.first[owner], n) + begin
            row = np.repeat(owner, n)
            yield pa.RecordBatch.from_arrays(
                [
                    taken(batch, "doc_id", row), taken(batch, "text_hash", row), pa.array(np.repeat(flat.field("anchor").to_numpy(), n)),
                    signed(stretch(total, at, at + words)), pa.array(begin.astype(np.int32)), pa.array(np.repeat(many, n)),
                ],
                names=["doc_id", "text_hash", "anchor", "window", "start", "many"],
            )

    return rows


def repeated_runs(docs: DataFrame, words: int = MIN_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, text_hash, start, n: from the word `start` on, n windows in a row of `words` words that also start elsewhere.

    docs has doc_id, text_hash and text. Texts of fewer words, null ones included, have none. Rows equal
    in id and text are two places."""
    seed = min(seed, words)
    anchors = stored(docs.mapInArrow(_anchors(words, seed), "doc_id long, text_hash long, anchor long, run long, start int, n int"), "anchors")
    met = anchors.groupBy("anchor").agg(F.count("*").alias("places"), F.min("run").alias("low"), F.max("run").alias("high"))
    met = stored(met.filter("places > 1").select("anchor", (F.col("low") != F.col("high")).alias("several")), "anchors-met")
    places = stored(anchors.join(met, "anchor"), "places")
    whole = places.filter("NOT several").select("doc_id", "text_hash", "start", "n")

    place = F.struct("doc_id", "text_hash", "start", "n")
    classes = places.filter("several").groupBy("anchor", "run").agg(F.count("*").alias("places"), F.min(place).alias("p"))
    classes = stored(classes.select("anchor", "run", (F.col("places") > 1).alias("many"), "p.doc_id", "p.text_hash", "p.start", "p.n"), "runs")
    copied = places.filter("several").join(classes.filter("many").select("anchor", "run"), ["anchor", "run"]).select("doc_id", "text_hash", "start", "n")

    # the runs of one text are at most as many as its words
    runs = classes.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n", "anchor", "many")).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "runs")
    known = docs.join(runs, docs["doc_id"].eqNullSafe(runs["_id"]) & (docs["text_hash"] == runs["_hash"])).select("doc_id", "text_hash", "text", "runs")
    known = known.dropDuplicates(["doc_id", "text_hash"])  # repeated rows have equal windows
    windows = stored(known.mapInArrow(_windows(words), "doc_id long, text_hash long, anchor long, window long, start int, many boolean"), "windows")
    twice = stored(windows.groupBy("anchor", "window").agg(F.count("*").alias("classes")).filter("classes > 1").select("anchor", "window"), "windows-met")
    ends = windows.filter("NOT many").join(twice, ["anchor", "window"]).select("doc_id", "text_hash", "start", F.lit(1).alias("n"))
    return whole.unionByName(copied).unionByName(ends)


def _without(words: int, columns: int):
    def rows(batches):
        for batch, texts in blocks(batches):
            runs = batch.column(batch.schema.get_field_index("_runs"))
            spans, counts = runs.to_pylist(), texts.counts()
            kept, gone = [], np.zeros(len(texts), np.int64)
            for i, own in enumerate(spans):
                text = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().split()  # of bytes: at the same six characters
                if own:
                    edge = np.zeros(len(text) + 1, np.int64)
                    start, n = (np.array([s[f] for s in own]) for f in ("start", "n"))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + words - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone[i] = len(text) - int(stays.sum())
                    text = compress(text, stays.tolist())
                kept.append(b" ".join(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(counts, pa.int64()), pa.array(gone), pa.array(kept, pa.string())],
                names=[*batch.schema.names[:columns], "_n_words", "_n_removed", "_kept_text"],
            )

    return rows


def without_repeats(docs: DataFrame, words: int = MIN_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """docs with `_n_words`, `_n_removed` and `_kept_text`: the words that lie in no repeated window, joined by blanks.

    Windows are judged on the input. A null text has no words. Other columns are kept, but for those of the
    names above and `_id`, `_hash`, `_runs`."""
    docs = docs.drop("_n_words", "_n_removed", "_kept_text", "_id", "_hash", "_runs")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # a set: repeated rows have equal spans
    runs = repeated_runs(hashed, words, seed).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("_runs"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_runs")
    own = docs["doc_id"].eqNullSafe(runs["_id"]) & (F.xxhash64(docs["text"]) == runs["_hash"])
    rows = docs.join(runs, own, "left").drop("_id", "_hash")
    schema = T.StructType([*docs.schema, T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept_text", T.StringType())])
    return rows.mapInArrow(_without(words, len(docs.columns)), schema)


def op4_passages(spark, sf_dir) -> DataFrame:
    """What is left of all documents without windows of 35 words that repeat."""
    rows = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))
