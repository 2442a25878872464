"""The texts that a stream has written, aged as one store.

A stream writes texts batch by batch, each batch into a folder of its own, so a month lies in as many folders as
batches closed captures of it. A manifest names every month that was compacted or deleted: the generation that holds
its rows now, and the last batch that this covers. Readers go by the manifest; what later batches write for such a month
stands beside it until it is compacted again. A version of the manifest is written, as one file, before anything it
replaces is removed, so whatever fails and wherever, each row of an ended batch is read once.

One job at a time may age a store; the stream may run meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rendering import stored_in
from ..operators.retention import FILE_BYTES, _files, planned
from ..plans.scratch import _remove
from .batches import MARKERS

TEXTS, AGED, VERSIONS = "texts", "aged", "manifest"
ROWS = "host string, name string, part int, pos bigint, text string"
ENTRY = "month string, generation bigint, through bigint"
#: Rows of one capture that stay in one file.
PIECE_ROWS = 100_000

Entries = dict[str, tuple[int | None, int]]


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern: names of folders and files, not what is in them."""
    fs, target = _files(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(target) or ()]


def _value(path: str, key: str) -> str:
    """The value that a path's folder gives to a key."""
    return next(part.split("=", 1)[1] for part in path.split("/") if part.startswith(f"{key}="))


def manifest(spark: SparkSession, output: str) -> Entries:
    """By month, for those that were ever compacted or deleted: the generation of its rows (None: they are deleted) and the
    last batch that is covered. A row a month."""
    whole = [int(_value(p, "v")) for p in _names(spark, f"{output}/{VERSIONS}/v=*/*.parquet")]
    if not whole:
        return {}
    rows = spark.read.schema(ENTRY).parquet(f"{output}/{VERSIONS}/v={max(whole)}").collect()
    return {r["month"]: (r["generation"], r["through"]) for r in rows}


def _next(spark: SparkSession, output: str) -> int:
    """A number that no version and no generation has, broken-off ones included."""
    used = [int(_value(p, "v")) for p in _names(spark, f"{output}/{VERSIONS}/v=*")]
    used += [int(_value(p, "generation")) for p in _names(spark, f"{output}/{AGED}/generation=*")]
    return max(used, default=0) + 1


def _publish(spark: SparkSession, output: str, number: int, entries: Entries) -> None:
    rows = [(month, *entry) for month, entry in sorted(entries.items())]
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{output}/{VERSIONS}/v={number}")
    sweep(spark, output)


def sweep(spark: SparkSession, output: str) -> None:
    """Remove the folders that the manifest has replaced, what broken-off compactions have left, and older versions."""
    entries = manifest(spark, output)
    for path in _names(spark, f"{output}/{TEXTS}/batch=*/month=*"):
        month = _value(path, "month")
        if month in entries and int(_value(path, "batch")) <= entries[month][1]:
            _remove(spark, path)
    for path in _names(spark, f"{output}/{AGED}/generation=*/month=*"):
        if entries.get(_value(path, "month"), (None,))[0] != int(_value(path, "generation")):
            _remove(spark, path)
    for version in sorted(int(_value(p, "v")) for p in _names(spark, f"{output}/{VERSIONS}/v=*/*.parquet"))[:-1]:
        _remove(spark, f"{output}/{VERSIONS}/v={version}")


def _ended(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("id bigint, batch bigint").parquet(f"{output}/{MARKERS}").select("batch").distinct()


def _counted(rows: DataFrame, spark: SparkSession, output: str, entries: Entries) -> DataFrame:
    """The rows (month, batch) of ended batches that the manifest does not cover."""
    covered = spark.createDataFrame([(m, t) for m, (_, t) in entries.items()], "month string, _through bigint")
    rows = rows.join(_ended(spark, output), "batch", "left_semi").join(covered, "month", "left")
    return rows.where(F.col("batch") > F.coalesce("_through", F.lit(-1))).drop("_through")


def _texts(spark: SparkSession, output: str, entries: Entries) -> DataFrame:
    """month, batch, host, name, part, pos, text of each text that has not been deleted, once."""
    columns = ("month", "batch", "host", "name", "part", "pos", "text")
    fresh = spark.read.schema(f"{ROWS}, batch bigint, month string, `group` string").parquet(f"{output}/{TEXTS}")
    fresh = _counted(fresh.select(*columns), spark, output, entries).select(*columns)
    folders = [f"{output}/{AGED}/generation={g}/month={m}" for m, (g, _) in sorted(entries.items()) if g is not None]
    if not folders:
        return fresh
    aged = spark.read.option("basePath", f"{output}/{AGED}").schema(f"{ROWS}, batch bigint, generation bigint, month string")
    return fresh.unionByName(aged.parquet(*folders).select(*columns))


def stream_texts(spark: SparkSession, output: str) -> DataFrame:
    """The rows of the texts of all ended batches that were not deleted, with the path that a capture's record names,
    whether its folder is still there or was compacted."""
    rows = _texts(spark, output, manifest(spark, output))
    folder = F.concat(F.lit(f"{output}/{TEXTS}/batch="), F.col("batch").cast("string"), stored_in("", F.col("month"), F.col("host")))
    return rows.withColumn("path", F.concat(folder, F.lit("#"), "host", F.lit("/"), "name"))


def stream_usage(spark: SparkSession, output: str) -> DataFrame:
    """Per month of a stream's texts what partition_usage tells of a folder: bytes, newest change, number of files and whether
    all are compacted. Replaced files and those of a batch that has not ended do not count; contents are not read."""
    entries = manifest(spark, output)
    roots = [f"{output}/{name}" for name in (TEXTS, AGED) if _names(spark, f"{output}/{name}")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    key = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    files = files.select("length", "modificationTime", *[key(k).alias(k) for k in ("month", "batch", "generation")]).where("month <> ''")
    fresh = _counted(files.where("generation = ''").withColumn("batch", F.col("batch").cast("bigint")), spark, output, entries)
    now = spark.createDataFrame([(m, str(g)) for m, (g, _) in entries.items() if g is not None], "month string, generation string")
    aged = files.join(now, ["month", "generation"], "left_semi")
    both = fresh.select("month", "length", "modificationTime", F.lit(False).alias("packed")).unionByName(
        aged.select("month", "length", "modificationTime", F.lit(True).alias("packed"))
    )
    return both.groupBy(F.lit(output).alias("root"), "month").agg(
        F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"), F.count("*").alias("entries"), F.bool_and("packed").alias("compacted")
    )


def _last_ended(spark: SparkSession, output: str) -> int:
    last = _ended(spark, output).agg(F.max("batch").alias("n")).first()["n"]
    return -1 if last is None else last


def compact_stream(spark: SparkSession, output: str, months: list[str], file_bytes: int = FILE_BYTES) -> dict[str, int]:
    """Rewrite months, from all batches that have ended and what was compacted of them before, as few zstd files of about
    file_bytes, all in one job; gives the rows of each. The new files count when they hold as many rows of each month."""
    entries, through, number = manifest(spark, output), _last_ended(spark, output), _next(spark, output)
    rows = _texts(spark, output, entries).where(F.col("month").isin(months) & (F.col("batch") <= through))
    before = {r["month"]: r["count"] for r in rows.groupBy("month").count().collect()}
    if not before:
        return {}
    sizes = {r["month"]: r["bytes"] for r in stream_usage(spark, output).where(F.col("month").isin(list(before))).collect()}  # a row a month
    files = {m: max(1, -(-sizes.get(m, 0) // file_bytes)) for m in before}
    counts = F.create_map(*[F.lit(x) for m, n in files.items() for x in (m, n)])
    stretch = F.call_function("div", F.col("pos"), F.lit(PIECE_ROWS).cast("long"))
    piece = F.pmod(F.xxhash64("host", "name", "batch", stretch), counts[F.col("month")])
    packed = rows.withColumn("_piece", piece).repartition(sum(files.values()), "month", "_piece")
    packed = packed.sortWithinPartitions("month", "_piece", "host", "name", "batch", "part", "pos").drop("_piece")
    fresh = f"{output}/{AGED}/generation={number}"
    packed.write.mode("errorifexists").partitionBy("month").option("compression", "zstd").parquet(fresh)
    written = spark.read.schema("month string").parquet(fresh)
    after = {r["month"]: r["count"] for r in written.groupBy("month").count().collect()}
    if before != after:
        _remove(spark, fresh)
        raise RuntimeError(f"compacting {output} gave {after} of {before} rows; the months are unchanged")
    _publish(spark, output, number, entries | {m: (number, through) for m in before})
    return after


def delete_stream_months(spark: SparkSession, output: str, months: list[str]) -> None:
    """Remove months as far as batches have ended. Captures of such a month that a later batch closes are kept anew."""
    if months:
        gone = dict.fromkeys(months, (None, _last_ended(spark, output)))
        _publish(spark, output, _next(spark, output), manifest(spark, output) | gone)


def apply_stream_plan(spark: SparkSession, output: str, plan: DataFrame) -> dict[str, list[str]]:
    """Carry out a retention or purge plan of stream_usage (a row a month; without an action: delete)."""
    done = planned(plan)
    delete_stream_months(spark, output, done["delete"])
    if done["compact"]:
        compact_stream(spark, output, done["compact"])
    return done
