"""Mixing sources to target weights in blocks of a fixed number of tokens.

The words of each source, one document after the other, are packed into blocks of `block` words; a
document's part of a block is a span. The number of blocks that each source gives to the mix
follows from its target. Each output shard draws its counts of blocks by source from a multinomial
law over the targets, seeded by the shard's number, so shards are drawn by tasks that know nothing of each other; with many
sources the draw goes down a tree of them, `FAN` branches at a time, which gives the same law.
Running sums over the shards tell which slots of its source a shard takes. A source that has given all its slots gives no more,
and what a source still owes after all draws fills a few shards at the end, so targets are met
to within a block. The i-th slot of a source takes the block to which a
keyed pseudorandom permutation of the source's block numbers sends i; slots past the last block start
the next pass over the source. Slots and blocks are joined by (source, block).
"""

from __future__ import annotations

from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern.llm.tables import parts, table
from loglantern.llm.words import blocks, mixed
from loglantern.plans.ordered import number_rows, scan
from loglantern.plans.scratch import stored

BLOCK_WORDS = 32
#: Slots of an output shard.
SHARD_SLOTS = 1 << 12
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_PASSES = 1.5, 2
#: Slots spelled out from one row.
CUT = 4096
#: Branches of a node in the tree of sources.
FAN = 256


def target_table(sources: DataFrame, total: float, most: float = MOST_PASSES) -> DataFrame:
    """sources (with `source_size`, `weight`) and `target`, the words wanted of each: `total` by weight, none above `most` times its
    size; what is above is shared anew among those below. Each round is one sum over the sources; once full, a source stays so."""
    full = F.lit(False)
    while True:
        open_ = (F.col("source_size") > 0) & ~full
        sums = sources.agg(
            F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
            F.count_if(full).alias("n"),
        ).first()
        if not sums["weight"]:
            break
        left = float(total) - most * sums["full"]
        share = F.lit(left) * F.col("weight") / F.lit(float(sums["weight"]))
        # the level only rises, so all that are full stay above it
        full = (F.col("source_size") > 0) & (share > most * F.col("source_size"))
        if sources.agg(F.count_if(full).alias("n")).first()["n"] == sums["n"]:
            break
    share = share if sums["weight"] else F.lit(0.0)
    want = F.when(full, (most * F.col("source_size")).cast("double")).when(F.col("source_size") > 0, share)
    return sources.withColumn("target", F.coalesce(want, F.lit(0.0)))


_DRAWN = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])


def _draw_rows(seed: int, level: int):
    """Share out the slots that a shard draws in a node of the tree of sources among the node's branches."""

    def rows(batches):
        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                weights = np.array([b["slots"] for b in row["branches"]], np.float64)
                dice = np.random.Generator(np.random.PCG64([seed, level, row["node"], row["shard"]]))
                counts = dice.multinomial(row["n"], weights / weights.sum())
                for i in np.flatnonzero(counts).tolist():
                    for column, value in zip(out, (row["shard"], row["branches"][i]["node"], int(counts[i])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_DRAWN)

    return rows


def shard_draws(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> DataFrame:
    """shard, source_number, first, count, place, slots: a shard takes `count` slots of a source from its slot `first` on, at
    the places `place` and on of its `slots`. sources: source_number from 0, slots."""
    spark = sources.sparkSession
    sources = sources.where("slots > 0").select("source_number", "slots")
    sums = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.coalesce(F.max("source_number"), F.lit(0)).alias("last")).first()
    total, depth = sums["slots"], 1
    while FAN**depth <= sums["last"]:
        depth += 1
    shards, salts = -(-total // shard_slots), parts(spark)
    div = lambda c, n: F.call_function("div", c, F.lit(n).cast("long"))
    drawn = spark.range(0, shards, 1, salts).select(
        F.col("id").alias("shard"), F.lit(0).cast("long").alias("node"), F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("id") * shard_slots).alias("n")
    )
    for level in reversed(range(depth)):
        nodes = sources.groupBy(div(F.col("source_number"), FAN**level).alias("node")).agg(F.sum("slots").alias("slots"))
        lists = nodes.groupBy(div(F.col("node"), FAN).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "slots"))).alias("branches"))
        # every shard draws in a big node, so its list is there once for each part of the shards
        lists = stored(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "mix-branches")
        drawn = drawn.withColumn("salt", F.pmod(F.col("shard"), F.lit(salts)).cast("int")).join(lists, ["node", "salt"])
        drawn = drawn.select("shard", "node", "n", "branches").mapInArrow(_draw_rows(seed, level), "shard long, node long, n long")
    drawn = stored(drawn.withColumnRenamed("node", "source_number"), "mix-drawn")
    counted = scan(drawn, ["source_number"], F.col("n"), "to", how="sum", seq="shard").join(sources, "source_number")
    counted = stored(counted.select("shard", "source_number", "slots", F.least(F.col("to") - F.col("n"), "slots").alias("first"), F.least("to", "slots").alias("to")), "mix-counted")
    taken = counted.select("shard", "source_number", "first", (F.col("to") - F.col("first")).alias("count")).where("count > 0")

    given = counted.groupBy("source_number").agg(F.max("to").alias("to"))
    owed = sources.join(given, "source_number", "left").withColumn("first", F.coalesce("to", F.lit(0))).where("slots > first")
    owed = stored(owed.select("source_number", "slots", "first", (F.col("slots") - F.col("first")).alias("n"), F.lit(0).alias("all")), "mix-owed")
    owed = scan(owed, ["all"], F.col("n"), "to", how="sum", seq="source_number").withColumn("from", F.col("to") - F.col("n"))
    cells = F.sequence(div(F.col("from"), shard_slots), div(F.col("to") - 1, shard_slots))
    owed = owed.withColumn("cell", F.explode(cells))
    low, high = F.greatest(F.col("from"), F.col("cell") * shard_slots), F.least(F.col("to"), (F.col("cell") + 1) * shard_slots)
    last = owed.select((F.col("cell") + shards).alias("shard"), "source_number", (F.col("first") + low - F.col("from")).alias("first"), (high - low).alias("count"))

    # a shard has at most as many rows as slots
    shard = Window.partitionBy("shard")
    before = F.sum("count").over(shard.orderBy("source_number").rowsBetween(Window.unboundedPreceding, -1))
    return taken.unionByName(last).select(
        F.col("shard").cast("int"), "source_number", "first", "count", F.coalesce(before, F.lit(0)).alias("place"), F.sum("count").over(shard).alias("slots")
    )


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed pseudorandom order of 0 to n - 1 sends each index: a Feistel network of four rounds
    over the next even number of bits, walked on from values of n and more."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & low
        for r in range(4):
            left, right = right, left ^ (mixed(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64)) & low)
        out[todo] = (left << half) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


_SLOT = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("pass", pa.int32()), ("source_number", pa.int64()), ("block", pa.int64())])


def _slot_rows(seed: int):
    """Spell out runs of slots: the shard's place and the source's block of each."""

    def rows(batches):
        for batch in batches:
            for run in batch.to_pylist():
                k = np.arange(run["cut"], run["stop"])
                i, n = run["first"] + k, run["blocks"]
                block = permuted(i % n, n, seed * 1_000_003 + run["source_number"])
                place = permuted(run["place"] + k, run["slots"], seed * 2_000_003 + run["shard"])
                shard, source = pa.array(np.full(len(k), run["shard"], np.int32)), pa.array(np.full(len(k), run["source_number"], np.int64))
                yield pa.RecordBatch.from_arrays([shard, pa.array(place), pa.array((i // n).astype(np.int32)), source, pa.array(block)], schema=_SLOT)

    return rows


def mix_spans(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The documents with their places, and the spans of the mix.

    Documents: `doc_id, text_hash, source, size, source_number, source_size, target, offset`, one for each row of docs.
    Spans: `shard, place, pass, source_number, block, offset, start, n`: that place of that shard takes the words
    start to start + n of the document at the offset of the source; `pass` counts earlier times.
    Sources take the weights in order of code point, null last, repeating. Documents without words
    have no span, repeated rows are documents of their own, an empty table gives empty results. Reads
    doc_id, source, size and text_hash (see `sized`); other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text_hash", "source", F.col("size").cast("long").alias("size"))
    # a row that is repeated, however often, is one row until the places are known
    docs = stored(docs.groupBy(*docs.columns).agg(F.count("*").alias("copies")), "mix-docs")
    found = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("rows"))
    found = found.select("*", F.col("source").isNull().alias("none"), F.lit(0).alias("all"))
    found = number_rows(found, ["all"], ["none", "source"]).withColumn("source_number", F.col("seq") - 1)
    cycle = F.create_map(*chain.from_iterable((F.lit(i), F.lit(float(w))) for i, w in enumerate(weights)))
    n_blocks = F.call_function("div", F.col("source_size") + (block - 1), F.lit(block).cast("long"))
    found = found.select("source", "source_number", "source_size", "rows", n_blocks.alias("blocks"), cycle[F.pmod("source_number", F.lit(len(weights))).cast("int")].alias("weight"))
    found = stored(found, "mix-sources")
    sums = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    # a slot has size / blocks words on average, as the last block of a source may be short
    slots = F.least(most * F.col("blocks"), F.bround(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    found = target_table(found, share * sums["size"], most)
    found = stored(found.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0))), "mix-targets")
    names = found.select(F.col("source").alias("name"), "source_number", "source_size", "target")
    docs = docs.join(names, docs["source"].eqNullSafe(names["name"])).drop("name")

    # places in two levels: within runs of about the square root of all rows, and over the runs
    runs = max(1, isqrt(sums["rows"]))
    docs = docs.withColumns({"_run": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(runs)), "_words": F.col("size") * F.col("copies")})
    over = Window.partitionBy("source_number").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = docs.groupBy("source_number", "_run").agg(F.sum("_words").alias("_n"))
    before = before.select("source_number", "_run", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("source_number", "_run").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_in", F.coalesce(F.sum("_words").over(inside), F.lit(0))).join(before, ["source_number", "_run"])
    docs = docs.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = docs.withColumn("offset", F.col("_in") + F.col("_from") + F.col("_copy") * F.col("size"))
    placed = stored(placed.select("doc_id", "text_hash", "source", "size", "source_number", "source_size", "target", "offset"), "mix-placed")

    numbers = F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")
    pieces = placed.filter("size > 0").select("source_number", "offset", "size", F.explode(numbers).alias("block"))
    low, high = F.greatest(F.col("offset"), F.col("block") * block), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("source_number", "block", "offset", (low - F.col("offset")).alias("start"), (high - low).alias("n"))

    drawn = shard_draws(found, shard_slots, seed).join(found.select("source_number", "blocks"), "source_number")
    drawn = drawn.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(CUT).cast("long"))))
    drawn = drawn.withColumn("stop", F.least(F.col("cut") + CUT, "count")).drop("count").repartition(parts(spark), "shard", "source_number", "cut")
    taken = drawn.mapInArrow(_slot_rows(seed), "shard int, place long, pass int, source_number long, block long")
    # spelled out rows are far more than Spark expects of the table they come from, so none may be broadcast
    return placed, taken.join(pieces.hint("merge"), ["source_number", "block"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and `size`, the number of words, of docs."""

    def rows(batches):
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(texts.counts(), pa.int64())], names=["doc_id", "source", "text_hash", "size"])

    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(rows, "doc_id long, source string, text_hash long, size long")


def _span_texts(columns: int):
    """The words of each row's spans; what lies between two words of one stretch stays as it is, stretches get a line each."""

    def rows(batches):
        for batch, texts in blocks(batches):
            spans, out = batch.column(batch.schema.get_field_index("_spans")).to_pylist(), []
            for i, own in enumerate(spans):
                stretches = []
                for s in sorted(own, key=lambda s: s["start"]):
                    if stretches and stretches[-1][1] == s["start"]:
                        stretches[-1][1] += s["n"]
                    else:
                        stretches.append([s["start"], s["start"] + s["n"]])
                at, raw = texts.first[i], texts.data
                out.append(b"\n".join(raw[texts.start[at + a] : texts.end[at + b - 1]].tobytes() for a, b in stretches).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(out, pa.string())], names=[*batch.schema.names[:columns], "_mixed"])

    return rows


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the columns of docs: a row for each pass in which any of a document's words is taken.

    The text holds the words taken in that pass, `n_chars` (if there) is its length. Documents of
    which nothing is taken, those without words included, are gone. Rows equal in id and text
    are told apart by their places, and each is put out as often as its places are taken.
    """
    docs = docs.drop("_id", "_hash", "_text_hash", "_spans", "_mixed")
    columns = docs.columns
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    placed, spans = mix_spans(sized(docs), **options)
    # a document has as many blocks as it is long
    own = spans.groupBy("source_number", "offset", "pass").agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    own = own.join(placed.filter("size > 0").select("source_number", "offset", "doc_id", "text_hash"), ["source_number", "offset"])
    own = own.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), "_spans")
    texts = docs.dropDuplicates(["doc_id", "_hash"])
    rows = texts.join(own, texts["doc_id"].eqNullSafe(own["_id"]) & (texts["_hash"] == own["_text_hash"])).select(*columns, "_spans")
    kept = [f for f in rows.schema if f.name != "_spans"]
    mixed_ = rows.mapInArrow(_span_texts(len(kept)), T.StructType([*kept, T.StructField("_mixed", T.StringType())]))
    new = {"text": F.col("_mixed")} | ({"n_chars": F.length("_mixed").cast("long")} if "n_chars" in columns else {})
    return mixed_.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in columns))


def op9_mixing(spark, sf_dir) -> DataFrame:
    """How many words of each document the mix takes, counted in its spans."""
    placed, spans = mix_spans(sized(table(spark, sf_dir, "documents", "doc_id", "source", "text")))
    taken = stored(spans.groupBy("source_number", "offset").agg(F.sum("n").alias("taken")), "mix-taken")
    with_words = placed.filter("size > 0").join(taken, ["source_number", "offset"], "left")
    rest = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return with_words.select(*columns).unionByName(rest.select(*columns))
