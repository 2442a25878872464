"""Order-dependent work per log source, split so that one busy source is never one task.

A dense line number cuts every source into equal buckets. Each function works inside
(source, bucket) groups, whose size is bounded by the bucket, and then carries one
summary row per bucket along the source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import stored

BUCKET = 65536
#: Buckets of one list of highest values.
FAN = 512


def bucket_of(seq: Column, size: int = BUCKET) -> Column:
    return F.call_function("div", seq, F.lit(size).cast("long"))


def placed(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df in the given order per key, written once, with its partition `_part` and a rising `_place`.

    Rows are range partitioned on (key, order), so a busy key spreads over many partitions."""
    rows = (
        df.repartitionByRange(*key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return stored(rows, "placed").withColumn("_part", F.shiftright("_place", 33))


def number_rows(df: DataFrame, key: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """Number rows 1.. per key in the given order: the place of a row in its partition, shifted by a count for
    each (key, partition). Those counts are a row for each partition and key, whatever the number of rows;
    they are written, so that the join knows their size and broadcasts them while they are small."""
    rows = placed(df, key, order)
    runs = rows.groupBy(*key, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        *key, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return (
        rows.join(stored(shifts, "shifts"), [*key, "_part"])
        .withColumn(out, F.col("_place") + F.col("_shift"))
        .drop("_part", "_place", "_shift")
    )


def scan(
    df: DataFrame,
    key: list[str],
    value: Column,
    out: str,
    *,
    how: str = "last",
    seq: str = "seq",
    size: int = BUCKET,
    backwards: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add a running value per key in seq order: the last non-null value, or the sum,
    min or max so far. backwards runs from the highest seq; inclusive counts the row itself."""
    place = F.desc if backwards else F.asc
    rows = df.select("*", bucket_of(F.col(seq), size).alias("_bucket"), value.alias("_value"))
    inside = (
        Window.partitionBy(*key, "_bucket")
        .orderBy(place(seq))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    across = (
        Window.partitionBy(*key).orderBy(place("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    )
    if how == "last":
        when_set = F.when(F.col("_value").isNotNull(), F.col(seq))
        total = (F.min_by if backwards else F.max_by)("_value", when_set)

        def running(name, over):
            return F.last(name, ignorenulls=True).over(over)

        def merged(local, before):
            return F.coalesce(local, before)
    else:
        function = getattr(F, how)
        total = function("_value")

        def running(name, over):
            return function(name).over(over)

        def merged(local, before):
            if how == "sum":
                return F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
            return F.least(local, before) if how == "min" else F.greatest(local, before)

    carried = (
        rows.groupBy(*key, "_bucket")
        .agg(total.alias("_total"))
        .select(*key, "_bucket", running("_total", across).alias("_before"))
    )
    kept = [c for c in df.columns if c != out]
    return (
        rows.select("*", running("_value", inside).alias("_local"))
        .join(carried, [*key, "_bucket"], "left")
        .select(*kept, merged(F.col("_local"), F.col("_before")).alias(out))
    )


def neighbours(df: DataFrame, key: list[str], value: Column, seq: str = "seq", size: int = BUCKET) -> DataFrame:
    """Add `before` and `after`: the value of the previous and the next row of the key in seq order."""
    rows = df.select("*", bucket_of(F.col(seq), size).alias("_bucket"), value.alias("_value"))
    inside = Window.partitionBy(*key, "_bucket").orderBy(seq)
    across = Window.partitionBy(*key).orderBy("_bucket")
    edges = (
        rows.groupBy(*key, "_bucket")
        .agg(F.min_by("_value", seq).alias("_first"), F.max_by("_value", seq).alias("_last"))
        .select(*key, "_bucket", F.lag("_last").over(across).alias("_prior"), F.lead("_first").over(across).alias("_later"))
    )
    near = rows.select("*", F.lag("_value").over(inside).alias("_lag"), F.lead("_value").over(inside).alias("_lead"))
    return near.join(edges, [*key, "_bucket"]).select(
        *df.columns, F.coalesce("_lag", "_prior").alias("before"), F.coalesce("_lead", "_later").alias("after")
    )


def _first_in_bucket(seq: str, values: list[str], carried: list[str], empty: pa.Table):
    """In one bucket of points, the first that reaches what each probe wants."""

    def rows(points: pa.Table, probes: pa.Table) -> pa.Table:
        if not points.num_rows or not probes.num_rows:
            return empty
        at = points.column(seq).to_numpy()
        order = np.argsort(at)
        which, want = probes.column("_which").to_numpy(), probes.column("_want").to_numpy()
        spot = np.zeros(len(want), np.int64)
        for i, value in enumerate(values):
            own = which == i
            spot[own] = np.searchsorted(points.column(value).to_numpy()[order], want[own], "left")
        found = pa.array(at[order][spot], pa.int64())
        return pa.Table.from_arrays([*(probes.column(c) for c in carried), probes.column("_which"), found], schema=empty.schema)

    return rows


def first_reaching(
    points: DataFrame, probes: DataFrame, key: list[str], values: list[str], seq: str = "seq", size: int = BUCKET, fan: int = FAN
) -> DataFrame:
    """For every probe, the seq of the first point of its key whose value is at least what the probe wants (null: none), for
    each of `values`, columns of both sides: never falling along seq in points, a wish in probes (null: none). A probe
    none of whose wishes is met is left out; the other columns of probes tell them apart.

    Values rise with seq, so a bucket's highest value tells whether the point lies in it or later. Those, a row a
    bucket, are held in lists of `fan` buckets under one list a key; a probe finds its bucket through two of them and meets the points of that
    one alone. Points are shuffled once, whatever the number of values."""
    rows = points.select(*key, bucket_of(F.col(seq), size).alias("_bucket"), seq, *values)
    highs = stored(rows.groupBy(*key, "_bucket").agg(*(F.max(v).alias(v) for v in values)), "highs")
    each = lambda: F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(v).alias("v")) for i, v in enumerate(values)))).alias("_e")
    group = F.call_function("div", F.col("_bucket"), F.lit(fan).cast("long"))
    high = highs.select(*key, group.alias("_group"), "_bucket", each()).select(*key, "_group", "_bucket", F.col("_e.which").alias("_which"), F.col("_e.v").alias("_high"))
    branches = high.groupBy(*key, "_which", "_group").agg(
        F.array_sort(F.collect_list(F.struct("_bucket", "_high"))).alias("_buckets"), F.max("_high").alias("_high")
    )
    roots = branches.groupBy(*key, "_which").agg(F.array_sort(F.collect_list(F.struct("_group", "_high"))).alias("_groups"))
    carried = [c for c in probes.columns if c not in values]
    wants = probes.select(*carried, each()).select(*carried, F.col("_e.which").alias("_which"), F.col("_e.v").alias("_want"))
    reaching = lambda c: F.get(F.filter(c, lambda e: e["_high"] >= F.col("_want")), 0)
    sent = wants.where(F.col("_want").isNotNull()).join(roots, [*key, "_which"]).withColumn("_group", reaching("_groups")["_group"])
    sent = sent.join(branches.drop("_high"), [*key, "_which", "_group"]).withColumn("_bucket", reaching("_buckets")["_bucket"])
    sent = sent.select(*carried, "_which", "_want", "_bucket")
    schema = wants.select(*carried, "_which", F.lit(0).cast("long").alias("_found")).schema
    empty = to_arrow_schema(schema).empty_table()
    by = [*key, "_bucket"]
    rows, sent = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (rows, sent))  # columns of their own on each side
    found = rows.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(_first_in_bucket(seq, values, carried, empty), schema)
    if len(values) == 1:
        return found.select(*carried, F.col("_found").alias(values[0]))
    return found.groupBy(*carried).agg(*(F.max(F.when(F.col("_which") == i, F.col("_found"))).alias(v) for i, v in enumerate(values)))
