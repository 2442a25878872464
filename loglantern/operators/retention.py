"""Month partitions of stored captures: usage, ageing, compaction, and deletion for space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import check
from .rendering import group_of, stored_in

# A month in days, and the days a changed month is left alone.
MONTH_DAYS = 30
RECENT_DAYS = 1
MONTH_PATH = r"^/(?:month=)?([0-9]{4}-(?:0[1-9]|1[0-2]))/"
# Names of folders that a compaction makes; readers skip names that begin so.
FRESH, ASIDE = "_compact-", "_replaced-"
COMPACTED = ".zstd.parquet"
FILE_BYTES = 256 << 20


def write_captures(lines: DataFrame, root: str, mode: str = "append") -> None:
    """Capture lines as parquet, one folder per month; files are clustered by capture, and
    the line number in the key splits a large capture over several."""
    part = F.call_function("div", F.col("seq"), F.lit(1_000_000).cast("long"))
    clustered = lines.repartition("month", "host", part).sortWithinPartitions("month", "host", "open_seq", "seq")
    clustered.write.mode(mode).partitionBy("month").parquet(root)


def write_index(index: DataFrame, path: str, mode: str = "append") -> None:
    index.select(F.col("entry").alias("value")).write.mode(mode).text(path)


def write_rendered(rendered: DataFrame, named: DataFrame, root: str, mode: str = "append") -> None:
    """The rows of all captures as parquet, in the folders that their paths name: a folder for each month
    and group of hosts, whatever the number of captures. Rows are clustered by capture; a large capture is split over files."""
    rows = rendered.join(named.select("host", "open_seq", "month", "name"), ["host", "open_seq"])
    rows = rows.withColumns({"group": group_of(F.col("host")), "_piece": F.call_function("div", F.col("pos"), F.lit(100_000).cast("long"))})
    ordered = rows.repartition("month", "group", "host", "_piece").sortWithinPartitions("month", "group", "host", "name", "part", "pos")
    ordered.select("month", "group", "host", "name", "part", "pos", "text").write.mode(mode).partitionBy("month", "group").parquet(root)


def read_rendered(spark: SparkSession, root: str) -> DataFrame:
    """month, host, name, part, pos, text, and the path of each row's capture."""
    rows = spark.read.parquet(root)
    month = F.regexp_extract(F.col("_metadata.file_path"), "/month=([^/]+)/group=[^/]+/[^/]+$", 1)
    rows = rows.select(month.alias("month"), "host", "name", "part", "pos", "text")
    return rows.withColumn("path", F.concat(stored_in(root, F.col("month"), F.col("host")), F.lit("#"), "host", F.lit("/"), "name"))


def export_captures(spark: SparkSession, root: str, chosen: DataFrame, folder: str) -> None:
    """A folder of text for each of some chosen captures (host, name): folder/host/name."""
    rows = read_rendered(spark, root).join(chosen.select("host", "name"), ["host", "name"])
    ordered = rows.repartitionByRange("host", "name", "part", "pos").sortWithinPartitions("host", "name", "part", "pos")
    ordered.select("host", "name", "text").write.mode("append").partitionBy("host", "name").text(folder, lineSep="\n")


def partition_usage(spark: SparkSession, root: str) -> DataFrame:
    """Per month folder under root: bytes, newest change, number of files, and whether all of them are compacted.
    File contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", "modificationTime")
    )
    fs, top = _files(spark, root)
    below = F.substr("path", F.lit(len(fs.makeQualified(top).toString()) + 1))
    month = F.regexp_extract(below, MONTH_PATH, 1)
    return (
        files.withColumn("month", month).where(F.col("month") != "")
        .groupBy(F.lit(root).alias("root"), "month")
        .agg(
            F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"), F.count("*").alias("entries"),
            F.bool_and(F.col("path").endswith(COMPACTED)).alias("compacted"),
        )
    )


def retention_plan(usage: DataFrame, now: str, compact_after_months: int, delete_after_months: int) -> DataFrame:
    """The action for every month: delete, compact or keep, by its age at `now`; 0 turns one off."""
    check(compact_after_months=compact_after_months, delete_after_months=delete_after_months)
    age = F.datediff(F.lit(now).cast("date"), F.to_date(F.concat("month", F.lit("-01"))))

    def older(months):
        return F.lit(months > 0) & (age > MONTH_DAYS * months)

    done = F.coalesce(F.col("compacted"), F.lit(False)) if "compacted" in usage.columns else F.lit(False)
    return usage.withColumn(
        "action",
        F.when(older(delete_after_months), "delete")
        .when(older(compact_after_months) & ~done, "compact")
        .otherwise("keep"),
    )


def purge_plan(usage: DataFrame, needed: int, now: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fewest oldest months that free `needed` bytes; none when all together would not.
    The current month, kept months and months changed in the last day stay. One row per
    month and root, so a root's running total is over its months only."""
    at = F.lit(now).cast("timestamp")
    free = usage.where(
        (F.col("month") != F.date_format(at, "yyyy-MM"))
        & ~F.col("month").isin(*keep)
        & (F.col("newest") <= at - F.make_dt_interval(days=F.lit(RECENT_DAYS)))
    )
    oldest = Window.partitionBy("root").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    sized = free.withColumn("_before", F.coalesce(F.sum("bytes").over(oldest), F.lit(0))).withColumn(
        "_all", F.sum("bytes").over(Window.partitionBy("root"))
    )
    return sized.where((F.col("_before") < needed) & (F.col("_all") >= needed)).drop("_before", "_all")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _moved(fs, source, target) -> None:
    """Rename, or raise: a Hadoop rename may fail by returning False."""
    if not fs.rename(source, target):
        raise RuntimeError(f"{source} could not be renamed to {target}")


def recover_months(spark: SparkSession, root: str) -> None:
    """Undo what a compaction that broke off has left: a month that was put aside and not replaced comes back."""
    fs, top = _files(spark, root)
    if not fs.exists(top):
        return
    for name in [s.getPath().getName() for s in fs.listStatus(top)]:
        if name.startswith(ASIDE):
            old, month = _files(spark, f"{root}/{name}")[1], _files(spark, f"{root}/month={name[len(ASIDE) :][:7]}")[1]
            if fs.exists(month):
                fs.delete(old, True)
            else:
                _moved(fs, old, month)
        elif name.startswith(FRESH):
            fs.delete(_files(spark, f"{root}/{name}")[1], True)


def compact_months(spark: SparkSession, root: str, months: list[str], file_bytes: int = FILE_BYTES) -> dict[str, int]:
    """Rewrite months as few zstd files of about file_bytes, all in one job; gives the rows of each.

    A month is replaced only when the new files hold as many rows of it; whatever fails, each month is whole
    under its name or comes back by recover_months, which every call begins with."""
    recover_months(spark, root)
    if not months:
        return {}
    month = F.regexp_extract(F.col("_metadata.file_path"), "/month=([0-9-]{7})/[^/]+$", 1)
    sources = [f"{root}/month={m}" for m in months]
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*sources).withColumn("month", month)
    sizes = {r["month"]: r["bytes"] for r in partition_usage(spark, root).where(F.col("month").isin(months)).collect()}  # a row a month
    files = {m: max(1, -(-sizes.get(m, 0) // file_bytes)) for m in months}
    keys = [c for c in ("host", "open_seq", "seq") if c in rows.columns]
    counts = F.create_map(*[F.lit(x) for m, n in files.items() for x in (m, n)])
    piece = F.pmod(F.xxhash64(*(keys or [c for c in rows.columns if c != "month"])), counts[F.col("month")])
    fresh = f"{root}/{FRESH}{uuid.uuid4().hex}"
    packed = rows.withColumn("_piece", piece).repartition(sum(files.values()), "month", "_piece").sortWithinPartitions("month", "_piece", *keys)
    packed.drop("_piece").write.mode("errorifexists").partitionBy("month").option("compression", "zstd").parquet(fresh)
    before = {r["month"]: r["count"] for r in rows.groupBy("month").count().collect()}
    written = spark.read.option("recursiveFileLookup", "true").parquet(fresh).withColumn("month", month)
    after = {r["month"]: r["count"] for r in written.groupBy("month").count().collect()}
    fs, new = _files(spark, fresh)
    if before != after:
        fs.delete(new, True)
        raise RuntimeError(f"compacting {root} gave {after} of {before} rows; the months are unchanged")
    for m, source in zip(months, sources, strict=True):
        _replaced(spark, root, m, source, f"{fresh}/month={m}")
    fs.delete(new, True)
    return {m: after.get(m, 0) for m in months}


def _replaced(spark: SparkSession, root: str, month: str, source: str, fresh: str) -> None:
    """Put a month's new folder in the place of the old one, which is put back if that fails."""
    fs, old = _files(spark, source)
    aside, new = (_files(spark, p)[1] for p in (f"{root}/{ASIDE}{month}-{uuid.uuid4().hex}", fresh))
    _moved(fs, old, aside)
    try:
        _moved(fs, new, old)
    except Exception:
        _moved(fs, aside, old)
        raise
    fs.delete(aside, True)


def compact_month(spark: SparkSession, root: str, month: str, file_bytes: int = FILE_BYTES) -> int:
    """compact_months for one month; gives its rows."""
    return compact_months(spark, root, [month], file_bytes)[month]


def planned(plan: DataFrame) -> dict[str, list[str]]:
    """The months that a plan (a row a month) deletes and compacts."""
    rows = plan.select("month", (F.col("action") if "action" in plan.columns else F.lit("delete")).alias("action")).collect()
    return {a: sorted(r["month"] for r in rows if r["action"] == a) for a in ("delete", "compact")}


def apply_plan(spark: SparkSession, root: str, plan: DataFrame) -> dict[str, list[str]]:
    """Carry out a retention or purge plan (a row a month; without an action: delete) on a store's months."""
    done = planned(plan)
    delete_months(spark, root, done["delete"])
    compact_months(spark, root, done["compact"])
    return done


def delete_months(spark: SparkSession, root: str, months: list[str]) -> None:
    """Remove planned months: a plan has one row per month, so it is small enough to collect."""
    for month in months:
        fs, target = _files(spark, f"{root}/month={month}")
        fs.delete(target, True)
