"""Shuffled shards by a two-pass external shuffle.

Pass one scatters records into buckets by a seeded hash; there are as many buckets as keep each
within a task's memory. Pass two sorts each bucket, so that a rerun starts from the same order,
shuffles it by Fisher-Yates and writes it. Bucket sizes, summed up, give each record its place in
one order of all records; places are dealt to the shards in turn, so their counts are at most one
apart. A hot source or a group of equal texts is scattered like any other rows, as the hash is of
all columns; rows equal in every column, the id included, are numbered and scattered by their numbers too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.tables import table, text_size
from loglantern.plans.ordered import number_rows, scan
from loglantern.plans.scratch import stored

BUCKET_BYTES = 32 << 20
SHARDS = 24


def _fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform order of n rows: position i swaps with a drawn one of those up to i."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(1, n + 1))
    rows, picks = order.tolist(), draws.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        rows[i], rows[j] = rows[j], rows[i]
    return np.array(rows, np.int64)


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in uniformly random order over `shards` shards: `_shard`, and `_slot` from 0 without gaps.

    Counts of shards are at most one apart (`rows`). The order depends on the ids, the seed and the
    number of buckets. Null ids, null texts and repeated rows are placed like all others; no rows,
    no shards. Other columns are kept, maps excepted (they have no hash: Spark refuses them); columns named `_shard`, `_slot`, `_bucket`,
    `_deal`, `_copy` are replaced.
    """
    docs = docs.drop("_shard", "_slot", "_bucket", "_deal", "_copy")
    docs = docs.withColumn("_deal", F.xxhash64(F.lit(seed), *docs.columns))
    deals = docs.groupBy("_deal").agg(F.count("*").alias("n"), F.sum(text_size(F.col(text)) + 64).alias("bytes"))
    deals = stored(deals, "shard-deals")
    buckets = max(1, -(-(deals.agg(F.sum("bytes").alias("n")).first()["n"] or 0) // bucket_bytes))
    # equal rows are told apart by a number; which of them has which makes no difference
    repeated = stored(deals.where("n > 1").select("_deal"), "shard-repeated")
    again = docs.join(repeated, "_deal", "left_semi").withColumn("_row", F.monotonically_increasing_id())
    again = number_rows(again, ["_deal"], ["_row"], out="_copy").drop("_row")
    docs = docs.join(repeated, "_deal", "left_anti").withColumn("_copy", F.lit(1).cast("long")).unionByName(again)
    docs = docs.withColumn("_bucket", F.pmod(F.xxhash64("_deal", "_copy"), F.lit(buckets)))
    counts = docs.groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    starts = scan(stored(counts, "shard-counts"), ["_all"], F.col("n"), "start", how="sum", seq="bucket", inclusive=False)

    def place(rows: pa.Table, start: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_deal", "ascending"), ("_copy", "ascending"), (key, "ascending")])
        bucket, first = start.column("bucket")[0].as_py(), start.column("start")[0].as_py()
        rows = rows.take(pa.array(_fisher_yates(rows.num_rows, seed * 1_000_003 + bucket)))
        spot = np.arange(rows.num_rows, dtype=np.int64) + first
        rows = rows.drop_columns(["_deal", "_copy", "_bucket"])
        return rows.append_column("_shard", pa.array((spot % shards).astype(np.int32))).append_column("_slot", pa.array(spot // shards))

    schema = docs.drop("_deal", "_copy", "_bucket").withColumns({"_shard": F.lit(0).cast("int"), "_slot": F.lit(0).cast("long")}).schema
    return docs.groupBy("_bucket").cogroup(starts.groupBy("bucket")).applyInArrow(place, schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as one folder each, `_shard=N`, with the rows of each bucket in one file of it."""
    shuffled_shards(docs, **options).write.partitionBy("_shard").mode("overwrite").parquet(path)


def op8_sharding(spark, sf_dir) -> DataFrame:
    """Shards and slots of all documents, read from the shards as written."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    shards = stored(shuffled_shards(docs), "shards")
    return shards.select(
        "doc_id",
        (text_size(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
