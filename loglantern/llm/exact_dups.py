"""Exact duplicates of a history of texts, found through minimal perfect hashes over its distinct digests.

Texts are equal when they are so without blanks and 0x09 to 0x0D; a text's digest is the SHA-256 of the rest. The history's
distinct digests are dealt to shards by their first bytes. In each shard a minimal perfect hash gives every digest a
slot of its own, 0 to n - 1: digests are dealt to small groups, and the groups, largest first, each get a number (a
round and a shift) that sends their members to free slots. A slot holds the full digest and the locator of the
history's best row with that text. A perfect hash gives a slot to strangers too, so a lookup compares all bytes of
the slot's digest with its own: equal ones are repeats, the others are no members and are grouped among themselves.
Lookups of a shard are split into parts, so that a text that a third of all rows hold is looked up by many tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.llm.tables import remainder, table
from loglantern.llm.words import _SEPARATOR, blocks, mixed
from loglantern.plans.scratch import stored

#: Distinct digests of a shard, and members of a group of its perfect hash, on average.
SHARD_DIGESTS, GROUP_DIGESTS = 8192, 4
#: Rows that one task looks up in a shard; a shard with more has more parts.
PART_ROWS = 1 << 17

INDEX = "shard int, n int, numbers binary, digests binary, ids array<bigint>, chars array<bigint>, places array<bigint>, rows array<bigint>"


def _digest_rows(batches):
    for batch, texts in blocks(batches):
        raw, bounds = texts.data, texts.bounds
        kept = ~_SEPARATOR[raw]
        data, at = raw[kept].tobytes(), np.concatenate(([0], np.cumsum(kept)))[bounds].tolist()
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[bounds]  # bytes that begin a code point
        digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(np.diff(points), pa.int64())], names=["doc_id", "digest", "n_chars"]
        )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_chars (code points of the text as it is) and the row's `place`, written once: a row for each of docs.

    docs: doc_id, text, and columns that are ignored. A null text counts as empty."""
    return with_places(docs.select("doc_id", "text").mapInArrow(_digest_rows, "doc_id long, digest binary, n_chars long"))


def with_places(rows: DataFrame) -> DataFrame:
    """rows, written once with a number of their own each."""
    return stored(rows.withColumn("place", F.monotonically_increasing_id()), "places")


def _words(rows: np.ndarray) -> np.ndarray:
    """Digests (rows of 32 bytes) as rows of four numbers."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64).reshape(-1, 4)


def _group_of(words: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(words[:, 1]) % np.uint64(groups)).astype(np.int64)


def _spot(words: np.ndarray, rounds, n: int) -> np.ndarray:
    """A slot for each digest before the shift of its group, for the round of its group."""
    salt = np.asarray(rounds, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed(words[:, 2] ^ mixed(words[:, 3] + salt)) % np.uint64(n)).astype(np.int64)


def perfect_hash(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, slots) of distinct digests (n rows of 32 bytes): a number for each group, a slot for each digest.

    Every slot from 0 to n - 1 is taken once. A group's number is round * n + shift."""
    n, words = len(rows), _words(rows)
    groups = max(1, -(-n // GROUP_DIGESTS))
    group = _group_of(words, groups)
    order, size = np.argsort(group, kind="stable"), np.bincount(group, minlength=groups)
    first = np.concatenate(([0], np.cumsum(size)))
    numbers, slots = np.zeros(groups, np.int64), np.zeros(n, np.int64)
    free = np.ones(2 * n, bool)  # twice over, so that a shift is a slice
    for g in np.argsort(-size, kind="stable"):
        own = order[first[g] : first[g + 1]]
        if not len(own):
            break
        round_ = 0
        while True:
            spot = _spot(words[own], np.full(len(own), round_), n)
            if len(set(spot.tolist())) == len(own):
                fits = free[spot[0] : spot[0] + n].copy()
                for s in spot[1:]:
                    fits &= free[s : s + n]
                shift = int(fits.argmax())
                if fits[shift]:
                    break
            round_ += 1
        slots[own] = taken = (spot + shift) % n
        free[taken] = free[taken + n] = False
        numbers[g] = round_ * n + shift
    return numbers, slots


def slots_of(rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """The slot of each digest, a stranger's too."""
    words = _words(rows)
    number = numbers[_group_of(words, len(numbers))]
    return (_spot(words, number // n, n) + number % n) % n


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _shard_index(rows: pa.Table) -> pa.Table:
    """The one row of a shard: its perfect hash and its slots, in order."""
    raw = _raw(rows.column("digest"))
    numbers, slots = perfect_hash(raw)
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    at = rows.take(pa.array(order))
    lists = [pa.array([at.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("best_id", "best_chars", "best_place", "rows")]
    return pa.Table.from_arrays(
        [pa.array([rows.column("shard")[0].as_py()], pa.int32()), pa.array([len(slots)], pa.int32()), pa.array([numbers.tobytes()], pa.binary()),
         pa.array([raw[order].tobytes()], pa.binary()), *lists],
        names=["shard", "n", "numbers", "digests", "ids", "chars", "places", "rows"],
    )


def _shard_of(shards: int) -> Column:
    """The shard of a digest by its first eight bytes' low half, which the perfect hash does not use."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _best() -> Column:
    """Of equal texts the longest stays, then the one of the least id, no id last; rows equal in both are told apart by place."""
    return F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "place"))


def _grouped(rows: DataFrame, *key: str) -> DataFrame:
    found = rows.groupBy(*key).agg(_best().alias("_best"), F.count("*").alias("rows"))
    return found.select(*key, F.col("_best.doc_id").alias("best_id"), (-F.col("_best.less")).alias("best_chars"), F.col("_best.place").alias("best_place"), "rows")


def history_index(history: DataFrame, shard_digests: int = SHARD_DIGESTS) -> tuple[DataFrame, int]:
    """(index, number of shards) of digests of a history (doc_id, digest, n_chars, place): a row a shard, written once.

    Its lists are in order of slots. An empty history has no rows and one shard."""
    distinct = stored(_grouped(history, "digest"), "distinct-digests")
    shards = max(1, -(-distinct.count() // shard_digests))
    rows = distinct.withColumn("shard", _shard_of(shards))
    return stored(rows.groupBy("shard").applyInArrow(_shard_index, INDEX), "digest-index"), shards


_FOUND = (
    "doc_id long, digest binary, n_chars long, place long, known boolean, slot long, held_id long, held_chars long, held_place long, held_rows long"
)
_LONGS = ("slot", "held_id", "held_chars", "held_place", "held_rows")
_NONE = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.binary()), ("n_chars", pa.int64()), ("place", pa.int64()), ("known", pa.bool_()), *((c, pa.int64()) for c in _LONGS)]
).empty_table()


def _look_up(rows: pa.Table, index: pa.Table) -> pa.Table:
    """The slot of each row whose digest is the slot's, byte by byte; none for the others."""
    n_rows = rows.num_rows
    if not n_rows:
        return _NONE
    found = {c: pa.nulls(n_rows, pa.int64()) for c in _LONGS}
    if index.num_rows:
        shard = index.slice(0, 1).to_pylist()[0]
        raw, held = _raw(rows.column("digest")), np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
        slot = slots_of(raw, np.frombuffer(shard["numbers"], np.int64), shard["n"])
        hit = (raw == held[slot]).all(axis=1)
        found["slot"] = pa.array(shard["shard"] * (1 << 32) + slot, pa.int64(), mask=~hit)
        for name, own in (("held_id", "ids"), ("held_chars", "chars"), ("held_place", "places"), ("held_rows", "rows")):
            found[name] = pa.array(shard[own], pa.int64()).take(pa.array(slot, pa.int64(), mask=~hit))
    kept = ["doc_id", "digest", "n_chars", "place", "known"]
    return pa.Table.from_arrays([*(rows.column(c) for c in kept), *found.values()], names=[*kept, *found])


def looked_up(rows: DataFrame, index: DataFrame, shards: int, part_rows: int = PART_ROWS) -> DataFrame:
    """rows (doc_id, digest, n_chars, place, known) with the slot that holds their digest and its locator (held_id, held_chars,
    held_place, held_rows), null for digests that the history has not; written once."""
    rows = rows.withColumn("shard", _shard_of(shards))
    parts = rows.groupBy("shard").count().select("shard", (F.floor(F.col("count") / part_rows) + 1).cast("int").alias("parts"))
    parts = stored(parts, "lookup-parts")
    dealt = rows.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int")).drop("parts")
    spread = index.join(parts, "shard").select(*index.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = dealt.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(_look_up, _FOUND)
    return stored(found, "looked-up")


def exact_duplicates(docs: DataFrame, known: Column, shard_digests: int = SHARD_DIGESTS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, n_chars, digest, slot, keep_id, keep_chars, group_size, kept for every row of docs (doc_id, text; other columns are ignored).

    Rows for which `known`, a condition on doc_id, holds are the history; null counts as false. All rows are looked
    up in its index. Repeats of the history go to their slot's row unless a longer new text (or one as long, of a less
    id) takes its place; other rows are grouped by digest. Null texts are empty ones, null ids come last among
    equals, of rows equal in id and text one is kept; without rows the result is empty, and without a history all are grouped."""
    rows = digests(docs).withColumn("known", F.coalesce(known, F.lit(False)))
    index, shards = history_index(rows.where("known"), shard_digests)
    found = looked_up(rows, index, shards, part_rows)
    # New rows are added up before they meet what the slot holds; those that were looked up in vain by digest.
    new = found.where("NOT known")
    winners = stored(_grouped(new.where("slot IS NOT NULL"), "slot"), "slot-winners")
    others = stored(_grouped(new.where("slot IS NULL"), "digest"), "new-winners")
    members = found.where("slot IS NOT NULL").join(winners, "slot", "left")
    order = lambda chars, id_, place: F.struct((-F.col(chars)).alias("a"), F.col(id_).isNull().alias("b"), F.col(id_).alias("c"), F.col(place).alias("d"))
    held, best = order("held_chars", "held_id", "held_place"), order("best_chars", "best_id", "best_place")
    stays = F.when(F.col("rows").isNull() | (held < best), held).otherwise(best)
    size = F.col("held_rows") + F.coalesce("rows", F.lit(0))
    strangers = found.where("slot IS NULL").join(others, "digest")

    def told(rows: DataFrame, stays: Column, size: Column) -> DataFrame:
        rows = rows.withColumn("_stays", stays)
        return rows.select(
            "doc_id", "n_chars", "digest", "slot", F.col("_stays.c").alias("keep_id"), (-F.col("_stays.a")).alias("keep_chars"),
            size.cast("long").alias("group_size"), (F.col("_stays.d") == F.col("place")).alias("kept"),
        )

    return told(members, stays, size).unionByName(told(strangers, best, F.col("rows")))


def without_exact_duplicates(docs: DataFrame, known: Column) -> DataFrame:
    """The rows of docs that stay, with all columns; of rows equal in id and text, one."""
    keep = exact_duplicates(docs, known).where("kept").select(F.col("doc_id").alias("_keep_id"), F.col("digest").alias("_digest"), F.col("n_chars").alias("_n"))
    own = docs.drop("_keep_id", "_digest", "_n", "_text_hash")
    plain = F.sha2(F.translate(F.coalesce("text", F.lit("")), " \t\n\u000b\f\r", ""), 256)
    rows = own.withColumn("_text_hash", F.unhex(plain)).withColumn("_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text_hash") == F.col("_digest")) & (F.col("_chars") == F.col("_n"))
    return rows.dropDuplicates(["doc_id", "_text_hash", "_chars"]).join(keep, same, "left_semi").select(*own.columns)


def op11_exact_dups(spark, sf_dir) -> DataFrame:
    """Every document with the one that stays of those equal to it. The history is the half whose ids' crc32 is even."""
    found = exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), remainder(F.col("doc_id"), 2) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
