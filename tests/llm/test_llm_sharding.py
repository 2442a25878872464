import zlib
from collections import Counter, defaultdict

import numpy as np
from plain import DOCS, corpus
from pyspark.sql import functions as F

from loglantern.llm import queries, sharding


def places(df):
    return sorted((r["_shard"], r["_slot"], r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect())


def test_shards(spark):
    rows = corpus(2, 200)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_shard": F.lit("x"), "slot": F.lit("kept")})
    found = sharding.shuffled_shards(docs.repartition(5), shards=7, bucket_bytes=4000)
    assert found.columns == [c for c in docs.columns if c != "_shard"] + ["_shard", "_slot"]
    got = places(found)
    assert sorted(x[2] for x in got) == sorted(r[0] if r[0] is not None else -1 for r in rows)
    slots = {s: [x[1] for x in got if x[0] == s] for s in range(7)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert got == places(sharding.shuffled_shards(docs.repartition(2), shards=7, bucket_bytes=4000))
    assert got != places(sharding.shuffled_shards(docs, shards=7, bucket_bytes=4000, seed=8))
    order = [x[2] for x in sorted(got, key=lambda x: (x[1], x[0]))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def test_fisher_yates_is_uniform():
    seen = np.zeros((4, 4))
    for seed in range(4000):
        for place, row in enumerate(sharding._fisher_yates(4, seed)):
            seen[place, row] += 1
    assert abs(seen / 4000 - 0.25).max() < 0.04


def test_files_and_query(spark, tmp_path):
    rows = [r for r in corpus(2) if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op8_sharding"](spark, str(tmp_path)).collect()
    want = sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(r[0] for r in rows)
    assert {r["_shard"] for r in back.collect()} == {0, 1, 2}


def plain_shards(rows, shards, seed, buckets, hashed):
    """The shards by the rule, on lists: rows with their hash of all columns, bucketed, ordered, shuffled and dealt."""
    seen, by = Counter(), defaultdict(list)
    for row in rows:
        seen[row["deal"]] += 1
        by[hashed[row["deal"], seen[row["deal"]]] % buckets].append((row["deal"], seen[row["deal"]], row["doc_id"]))
    order = []
    for bucket in sorted(by):
        own = sorted(by[bucket])
        order.extend(own[i] for i in sharding._fisher_yates(len(own), seed * 1_000_003 + bucket))
    return sorted((i % shards, i // shards, x[2]) for i, x in enumerate(order))


def test_plain_and_repeated_rows(spark):
    """The whole result by a plain version, with a row that is there 400 times."""
    rows = [r for r in corpus(4, 60) if r[0] is not None] + [(-5, "the same row", "en", "a", 12)] * 400
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    known = docs.select("doc_id", F.xxhash64(F.lit(7), *docs.columns).alias("deal"), (F.octet_length(F.coalesce("text", F.lit(""))) + 64).alias("size")).collect()
    pairs = [(d, k) for d, n in Counter(r["deal"] for r in known).items() for k in range(1, n + 1)]
    table = spark.createDataFrame(pairs, "deal long, copy long")
    hashed = {(r["deal"], r["copy"]): r["h"] for r in table.select("*", F.xxhash64("deal", "copy").alias("h")).collect()}
    buckets = -(-sum(r["size"] for r in known) // 4000)
    assert buckets > 5
    found = sharding.shuffled_shards(docs, shards=7, bucket_bytes=4000)
    assert places(found) == plain_shards(known, 7, 7, buckets, hashed)
    in_bucket = Counter(hashed[p] % buckets for p in pairs if p[1] > 1)
    assert max(in_bucket.values()) < 400 / buckets * 4  # the copies are scattered


def test_a_row_many_times(spark):
    row = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a text").alias("text"))
    found = sharding.shuffled_shards(row, bucket_bytes=1 << 16).groupBy("_shard").agg(F.count("*").alias("n"), F.countDistinct("_slot").alias("d"), F.max("_slot").alias("top"))
    got = found.collect()
    assert len(got) == 24 and sum(r["n"] for r in got) == 100_000
    assert all(r["n"] == r["d"] == r["top"] + 1 for r in got)


def test_empty_table(spark):
    assert sharding.shuffled_shards(spark.createDataFrame([], DOCS)).collect() == []
