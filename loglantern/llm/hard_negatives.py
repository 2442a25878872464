"""Hard negatives of anchors: rows of other labels whose score is a set share of a positive's.

A row's score with an anchor is the inner product of their vectors in whole numbers. The positives of an anchor, highest
first, each ask for the best rows between a lower and an upper limit. These windows overlap, so they are not searched
one by one: the upper limits cut the scores into disjoint slots, slot j reaching from the next positive's limit
up to that of positive j. Each task keeps the first k rows of each slot and anchor, a shuffle adds them up to the first k
of all rows, and as every row of a slot comes before those of the next, the first k below positive j's limit
are the first k of slots j, j + 1 and so on. The lower limit then takes off the end of that list.

Anchors are a stated set of queries, met by all rows in blocks: rows are dealt to blocks by their number, anchors to blocks of
a bounded size, and a task gets one of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern.llm.exact_dups import with_places
from loglantern.llm.tables import parts, table
from loglantern.plans.scratch import stored

POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score, at least and at most.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows and anchors of a task, at most on average.
ROW_BLOCK, ANCHOR_BLOCK = 1 << 15, 1 << 11
#: Parts that the finds of an anchor are added up in before they are added up whole.
PARTS = 64
#: Scores are held to this, either way: vectors of components below 2**20 never reach it.
_MOST = 1 << 54

_SCORED = "anchor long, slot int, id long, place long, score long"
_NONE = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("place", pa.int64()), ("score", pa.int64())]).empty_table()


def whole_vectors(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """id, label, v (components as floor(256 * x)), dim and place of the rows that take part, written once.

    rows: vec_id, embedding, label. Rows with a null label, a null vector, or a null or non-finite component take no part."""
    x = lambda c: c.cast("double")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == F.lit(float("inf"))))
    fit = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    whole = F.transform("embedding", lambda c: F.floor(x(c) * SCALE).cast("double"))
    own = F.col("label") if label is None else label
    return with_places(fit.select(F.col("vec_id").alias("id"), own.cast("long").alias("label"), whole.alias("v"), F.size("embedding").alias("dim")))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, as 64-bit numbers, held to 2**54."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if np.abs(anchors).max() * np.abs(rows).max() * anchors.shape[1] < 2.0**53:
        return np.clip((anchors @ rows.T).astype(np.int64), -_MOST, _MOST)  # every sum on the way is exact in doubles
    as_ints = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(as_ints(anchors).dot(as_ints(rows).T), -_MOST, _MOST).astype(np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The first k places of the list: higher scores first, ties by smaller id, then by place."""
    if len(scores) > k:
        at_least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= at_least)
        return some[np.lexsort((places[some], ids[some], -scores[some]))[:k]]
    return np.lexsort((places, ids, -scores))


def _vectors(rows: pa.Table) -> np.ndarray:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, len(flat) // max(1, rows.num_rows))


def _ids(rows: pa.Table) -> np.ndarray:
    """Ids for order alone: no id comes last."""
    return rows.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()


def _kept(chosen: list[tuple[int, int, np.ndarray]], scores: np.ndarray, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    of = np.repeat([a for a, _, _ in chosen], [len(i) for _, _, i in chosen]).astype(np.int64)
    slot = np.repeat([s for _, s, _ in chosen], [len(i) for _, _, i in chosen]).astype(np.int32)
    index = np.concatenate([i for _, _, i in chosen]) if chosen else np.zeros(0, np.int64)
    pick = lambda table, name, at: table.column(name).combine_chunks().take(pa.array(at, pa.int64()))
    return pa.Table.from_arrays(
        [pick(anchors, "place", of), pa.array(slot), pick(rows, "id", index), pick(rows, "place", index), pa.array(scores[of, index], pa.int64())],
        names=["anchor", "slot", "id", "place", "score"],
    )


def _best_positives(k: int):
    """Of a block of rows of one label, each anchor's first k, itself left out."""

    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _NONE
        scores = products(_vectors(anchors), _vectors(rows))
        ids, places, own, chosen = _ids(rows), rows.column("place").to_numpy(), anchors.column("place").to_numpy(), []
        for a in range(len(scores)):
            others = np.flatnonzero(places != own[a])
            chosen.append((a, 0, others[first_of(scores[a, others], ids[others], places[others], k)]))
        return _kept(chosen, scores, anchors, rows)

    return best


def _best_per_slot(k: int):
    """Of a block of rows, the first k of every slot of each anchor: rows of its label and scores above its highest limit are none."""

    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _NONE
        scores = products(_vectors(anchors), _vectors(rows))
        ids, places, labels = _ids(rows), rows.column("place").to_numpy(), rows.column("label").to_numpy()
        own, limits, floors, chosen = anchors.column("label").to_numpy(), anchors.column("limits").to_pylist(), anchors.column("floor").to_numpy(), []
        for a in range(len(scores)):
            row, high = scores[a], np.array(limits[a])
            open_ = np.flatnonzero((labels != own[a]) & (row <= high[0]) & (row >= floors[a]))
            slot = np.searchsorted(-high, -row[open_], "right") - 1  # the last positive whose limit is not below the score
            for s in np.unique(slot):
                some = open_[slot == s]
                chosen.append((a, int(s), some[first_of(row[some], ids[some], places[some], k)]))
        return _kept(chosen, scores, anchors, rows)

    return best


def _met(anchors: DataFrame, rows: DataFrame, within: list[str], work, row_block: int, anchor_block: int) -> DataFrame:
    """Have every anchor meet all rows that agree with it on `within`, in blocks of bounded size."""
    spark = rows.sparkSession
    n_rows, n_anchors = rows.count(), anchors.count()
    row_blocks, anchor_blocks = max(parts(spark), -(-n_rows // row_block)), max(1, -(-n_anchors // anchor_block))
    dealt = lambda n: F.pmod(F.xxhash64("place"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # else both sides have one table's columns, and Spark mistakes them
    left = anchors.withColumn("ab", dealt(anchor_blocks)).withColumn("rb", every(row_blocks))
    right = rows.withColumn("rb", dealt(row_blocks)).withColumn("ab", every(anchor_blocks))
    key = [*within, "ab", "rb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, _SCORED)


def _order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc_nulls_last("id"), F.asc("place")]


def _first_k(met: DataFrame, key: list[str], k: int, nth: str) -> DataFrame:
    """The first k of each key, numbered from 1: of parts of its rows first, so that no task gets what all blocks found for it."""
    some = met.withColumn("_part", F.pmod(F.xxhash64("place"), F.lit(PARTS)))
    for own in ([*key, "_part"], key):
        some = some.withColumn(nth, F.row_number().over(Window.partitionBy(*own).orderBy(*_order()))).where(F.col(nth) <= k)
    return some.drop("_part")


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor (its place), nth (from 0), id and score of each anchor's first k other rows of the same label and length."""
    met = _met(anchors, rows, ["dim", "label"], _best_positives(k), row_block, anchor_block)
    return _first_k(met, ["anchor"], k, "_nth").select("anchor", (F.col("_nth") - 1).alias("nth"), "id", "score")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positive: int = POSITIVES, negative: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, for every anchor and each of its positives
    the first `negative` rows of other labels with low * positive <= 100 * score <= high * positive.

    rows: what whole_vectors gives; is_anchor: a condition on `id`, null counts as false. Vectors of another length do not
    meet. Equal rows are rows of their own, as anchors too; no id comes last among equal scores. Without
    rows, anchors, positives or negatives there is no result. Scores beyond 2**54 count as 2**54."""
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False))).select("id", "label", "v", "dim", "place")
    best = stored(positives(anchors, rows, positive, row_block, anchor_block), "positives")
    div = lambda n: F.call_function("div", n - F.pmod(n, F.lit(100)), F.lit(100).cast("long"))  # noqa: E731  rounded down
    limited = best.select("*", div(high * F.col("score")).alias("limit"), (-div(-low * F.col("score"))).alias("least"))
    asked = limited.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("nth", "id", "score", "limit", "least"))).alias("asked"), F.min("least").alias("floor")
    )
    asked = asked.withColumn("limits", F.col("asked.limit"))
    asking = anchors.join(asked.select(F.col("anchor").alias("place"), "limits", "floor"), "place")
    met = _met(asking, rows, ["dim"], _best_per_slot(negative), row_block, anchor_block)
    slots = _first_k(met, ["anchor", "slot"], negative, "_nth")
    # a few rows a slot and a few slots an anchor: all first ones in one list, in order
    entry = F.struct((-F.col("score")).alias("less"), F.col("id").isNull().alias("none"), "id", "place", "slot")
    lists = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    rows_ = asked.join(lists, "anchor").select("anchor", "found", F.explode("asked").alias("p"))
    below = F.slice(F.filter("found", lambda e: e["slot"] >= F.col("p.nth")), 1, negative)
    inside = F.filter(below, lambda e: -e["less"] >= F.col("p.least"))
    told = rows_.select("anchor", "p", F.posexplode(inside).alias("at", "e"))
    names = anchors.select(F.col("id").alias("anchor_id"), F.col("place").alias("anchor"))
    return told.join(names, "anchor").select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), (-F.col("e.less")).alias("negative_score"),
    )


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, a seventh of the labels moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), moved)
    return hard_negatives(rows, F.col("id") % 100 == 0)
