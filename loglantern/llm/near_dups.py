"""Near duplicates by HyperMinHash signatures.

A document's set of word shingles is cut by hash into 128 buckets. Of the least hash in each, a register
keeps the number of leading zeros and ten bits that follow (16 bits in all). Documents with
the same set are one class from then on. Registers, the empty ones filled from others by a fixed
pseudorandom order, are banded; documents that share a band are candidates. All of a band are compared with
one of them, so a group of many copies costs a star. What is then still of several components in a band is
compared by blocks, within the tasks. Before each comparison an estimate of the Jaccard similarity from the registers, less
the matches expected by chance, drops pairs far below the threshold; the others are confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.components import components
from loglantern.llm.tables import table
from loglantern.llm.words import blocks, mixed, shingles
from loglantern.plans.scratch import stored

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
#: Registers a band. A pair at 0.8 shares one of 32 bands of 4 but for 5 in 10**8.
BAND = 4
#: Pairs are dropped unseen when the estimate is so many standard deviations below the threshold.
DEVIATIONS = 6.0
#: Classes of a block, and shingles of all their sets, at most about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 18


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The registers of sorted distinct hashes, a row for each set; 0 is empty."""
    out = np.zeros((len(bounds) - 1, BUCKETS), np.uint16)
    if not len(hashes):
        return out
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = row * BUCKETS + bucket
    least = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    bits = 64 - BUCKET_BITS
    value = (hashes[least] & np.uint64((1 << bits) - 1)) | np.uint64(1 << MANTISSA_BITS)  # so that ten bits always follow
    # the exponent of the value, exactly: halves are turned into floats apart
    high = (value >> np.uint64(32)).astype(np.float64)
    low = (value & np.uint64(0xFFFFFFFF)).astype(np.float64)
    length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    mantissa = (value >> (length - 1 - MANTISSA_BITS).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    zeros = bits - length
    out.reshape(-1)[cell[least]] = (((zeros + 1) << MANTISSA_BITS) | mantissa.astype(np.int64)).astype(np.uint16)
    return out


def _lenders() -> np.ndarray:
    """From which bucket an empty one borrows, at each attempt: fixed pseudorandom numbers."""
    tries = 64 * BUCKETS
    return (mixed(np.arange(tries * BUCKETS, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(tries, BUCKETS)


_LENDERS: list[np.ndarray] = []


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with the empty ones of every row that has any filled."""
    if not _LENDERS:
        _LENDERS.append(_lenders())
    out = regs.copy()
    rows = np.flatnonzero((regs == 0).any(axis=1) & (regs != 0).any(axis=1))
    for lender in _LENDERS[0]:
        if not len(rows):
            break
        part = out[rows]
        out[rows] = part = np.where(part == 0, regs[rows][:, lender], part)
        rows = rows[(part == 0).any(axis=1)]
    return out


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that registers of sets of n and m elements agree by chance, for different least hashes."""
    x, y = n[:, None] / BUCKETS, m[:, None] / BUCKETS
    top = 2.0 ** -np.arange(0, 64 - BUCKET_BITS)[None, :]  # cells of one number of zeros lie from top / 2 to top
    width, both = top / 2 / 2**MANTISSA_BITS, x + y
    return (width * x * y / both * (np.exp(-both * top / 2) - np.exp(-both * top))).sum(axis=1)


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities of pairs of sets from their registers, corrected for chance, and the registers that speak."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    p = chance_matches(n.astype(float), m.astype(float))
    return (same / used - p) / (1 - p), used


def _distinct_shingles(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, bounds = shingles(texts.hashes(), texts.first, k)
    sets = [np.unique(hashes[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(sets) if sets else hashes, np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def _sums(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _signatures(k: int):
    def rows(batches):
        for batch, texts in blocks(batches, lower=True):
            sets, bounds = _distinct_shingles(texts, k)
            size = np.diff(bounds)
            names = np.stack([mixed(_sums(mixed(sets ^ np.uint64(c)), bounds) + size.astype(np.uint64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
            regs = registers(sets, bounds)
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(size, pa.int64()),
                    pa.array([None if e else x.tobytes() for x, e in zip(names, none, strict=True)], pa.binary()),
                    pa.array([None if e else x.tobytes() for x, e in zip(regs, none, strict=True)], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "class", "registers"],
            )

    return rows


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys = np.ascontiguousarray(filled(regs)).view(np.uint64)
        keys = mixed(keys + np.arange(keys.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
        rows = np.repeat(np.arange(len(keys)), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(rows))], names=["band", "class"])


def _sets(k: int):
    def rows(batches):
        for batch, texts in blocks(batches, lower=True):
            sets, bounds = _distinct_shingles(texts, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))],
                names=["class", "n_shingles", "registers", "shingles"],
            )

    return rows


def _near(percent: int):
    """Keep the pairs whose estimate does not rule the threshold out."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            guess, used = estimates(a, b, n, m)
            least = percent / 100
            possible = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            close = possible & (guess >= least - DEVIATIONS * np.sqrt(least * (1 - least) / used))
            yield batch.filter(pa.array(close)).select(["a", "b"])

    return rows


def _confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough: by estimate first, then on the full sets."""
    side = lambda x, *c: members.select(F.col("class").alias(x), *(F.col(k).alias(v) for k, v in c))
    rough = pairs.join(side("a", ("registers", "ra"), ("n_shingles", "na")), "a").join(side("b", ("registers", "rb"), ("n_shingles", "nb")), "b")
    near = stored(rough.mapInArrow(_near(percent), "a binary, b binary"), "near")
    full = near.join(side("b", ("shingles", "sb")), "b").join(side("a", ("shingles", "sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("both", both).filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _alone(members: DataFrame, among: DataFrame) -> DataFrame:
    """class, n, alone: the size of each set of some classes, and how many of its shingles no other of them has.

    A shingle met once names its class itself, so nothing is joined back."""
    own = members.join(among.select("class").distinct(), "class")
    once = own.select("class", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("sets"), F.first("class").alias("class"))
    once = once.filter("sets = 1").groupBy("class").agg(F.count("*").alias("alone"))
    return own.select("class", F.col("n_shingles").alias("n")).join(once, "class", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))


def _compared(percent: int):
    """Links between the classes of two blocks (or of one) that have different roots, as few as join what is linked.

    Estimates come first; the classes that have a pair left are compared on full sets, each with a whole block at once."""

    def sets(rows: pa.Table, names: np.ndarray):
        column = rows.column("shingles").combine_chunks()
        ends = column.offsets.to_numpy()
        return np.searchsorted(names, column.values.to_numpy()[ends[0] : ends[-1]]), ends - ends[0]

    def group(rows: pa.Table) -> pa.Table:
        left, right = (rows.filter(pc.equal(rows.column("side"), s)) for s in (0, 1))
        alone = not right.num_rows
        right = left if alone else right
        if not left.num_rows or left.num_rows + right.num_rows < 2 + alone:
            return _NO_LINKS
        names = np.unique(pc.list_flatten(rows.column("shingles").combine_chunks()).to_numpy())
        (ids_a, at_a), (ids_b, at_b) = sets(left, names), sets(right, names)
        size_a, size_b = np.diff(at_a), np.diff(at_b)
        regs_a, regs_b = (np.frombuffer(b"".join(r.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS) for r in (left, right))
        root_a, root_b = left.column("root").to_pylist(), right.column("root").to_pylist()
        number = {r: i for i, r in enumerate(dict.fromkeys(root_a + root_b))}
        root_a, root_b = (np.array([number[r] for r in x]) for x in (root_a, root_b))
        up, seen, out = list(range(len(number))), np.zeros(len(names), np.int32), []

        def top(i):
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i in range(len(size_a)):
            other = np.flatnonzero(root_b != root_a[i])
            other = other[other > i] if alone else other
            other = other[100 * np.minimum(size_b[other], size_a[i]) >= percent * np.maximum(size_b[other], size_a[i])]
            if len(other):
                guess, used = estimates(np.broadcast_to(regs_a[i], (len(other), BUCKETS)), regs_b[other], np.broadcast_to(size_a[i], len(other)), size_b[other])
                other = other[guess >= percent / 100 - DEVIATIONS * np.sqrt(percent / 100 * (1 - percent / 100) / used)]
            if not len(other):
                continue
            own = ids_a[at_a[i] : at_a[i + 1]]
            seen[own] = 1
            both = np.add.reduceat(seen[ids_b], at_b[:-1])[other]
            seen[own] = 0
            for j in other[100 * both >= percent * (size_a[i] + size_b[other] - both)]:
                x, y = top(root_a[i]), top(root_b[j])
                if x != y:
                    up[x] = y
                    out.append((i, int(j)))
        names_a, names_b = left.column("class").to_pylist(), right.column("class").to_pylist()
        return pa.table({"a": [names_a[i] for i, _ in out], "b": [names_b[j] for _, j in out]}, schema=_NO_LINKS.schema)

    return group


_NO_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())]).empty_table()


def _between_components(seats: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the classes of bands that hold several components.

    Classes are dealt into blocks of bounded size by the largest band that they are in. Two blocks that
    meet in a band are compared in one task; a class goes to as many tasks as its block meets others."""
    home = seats.groupBy("class").agg(F.max(F.struct("size", "band")).alias("home"), F.first("root").alias("root"))
    own = members.join(home.select("class", "root", F.col("home.band").alias("home")), "class")
    own = stored(own, "own")
    sizes = own.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    own = own.join(stored(sizes, "homes"), "home").withColumn("part", F.pmod(F.xxhash64("class"), F.col("blocks")))
    own = stored(own.withColumn("block", F.struct("home", "part")).drop("home", "part", "blocks"), "own")
    meet = stored(seats.select("band", "class").join(own.select("class", "block"), "class").select("band", "block").distinct(), "meet")
    pairs = meet.join(meet.withColumnRenamed("block", "other"), "band").filter("block <= other").select("block", "other").distinct()
    sides = F.explode(F.expr("CASE WHEN block = other THEN array(struct(0 AS side, block AS at)) ELSE array(struct(0 AS side, block AS at), struct(1 AS side, other AS at)) END"))
    tasks = stored(pairs.select("block", "other", sides.alias("s")).select("block", "other", "s.side", "s.at"), "tasks")
    rows = tasks.join(own.withColumnRenamed("block", "at"), "at").select("block", "other", "side", "class", "root", "registers", "shingles")
    return rows.groupBy("block", "other").applyInArrow(_compared(percent), "a binary, b binary")


def class_links(classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between classes (a, b) by which all linked classes can be reached.

    First each band's members are compared with one of them. Then only bands of several components matter. Members
    that have too many shingles alone to be linked with any other leave them; the rest of such bands are compared by blocks."""
    bands = classes.select("class", "registers").mapInArrow(_bands, "band long, class binary")
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    seats = stored(bands.join(shared.hint("merge"), "band"), "seats")
    inside = seats.select("class").distinct().join(classes, "class").select("class", "n_shingles", "registers", "rep.doc_id", "rep.text_hash")
    same = texts["doc_id"].eqNullSafe(inside["doc_id"]) & (texts["text_hash"] == inside["text_hash"])
    # a representative's row may be repeated in the table: one is taken
    members = inside.join(texts, same).select("class", "n_shingles", "registers", "text").dropDuplicates(["class"])
    members = stored(members.mapInArrow(_sets(k), "class binary, n_shingles long, registers binary, shingles array<long>"), "members")

    pivot = stored(seats.groupBy("band").agg(F.min("class").alias("a")), "pivots")
    pairs = seats.join(pivot, "band").filter("class != a").select("a", F.col("class").alias("b")).distinct()
    links = stored(_confirmed(stored(pairs, "pairs"), members, percent), "links")
    root = components(links).select(F.col("node").alias("class"), F.col("component").alias("root"))
    seats = stored(seats.join(root, "class", "left").withColumn("root", F.coalesce("root", "class")), "seats")
    seats = _split(seats)
    known = stored(_alone(members, seats).filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")), "not-alone")
    seats = _split(seats.join(known.select("class"), "class"))
    return stored(links.unionByName(_between_components(seats, members, percent)), "links")


def _split(seats: DataFrame) -> DataFrame:
    """The seats of bands that have members of several components."""
    several = seats.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("band")
    return stored(seats.join(stored(several, "split"), "band"), "seats")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component, component_id, kept for each row of docs (its doc_id and text).

    Two documents are linked when their sets of k-word shingles (A-Z in lower case) overlap by `percent` of their
    union or more. component_id is the least doc_id that can be reached. A text of fewer words than k is one
    shingle. Null and wordless texts have none and link with nothing. A null id is never a component's
    unless all its ids are null. Equal texts are one class, whatever their ids; repeated rows are kept apart.
    Where ids are null or tied, several components have one component_id; `component`, the least class of each (null
    for texts without shingles), tells them apart, and several rows of a component may be kept."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = texts.mapInArrow(_signatures(k), "doc_id long, text_hash long, n_shingles long, class binary, registers binary")
    rows = stored(rows, "signatures")
    rep = F.min(F.struct("doc_id", "text_hash", "n_shingles", "registers")).alias("rep")
    classes = rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("low"), rep)
    classes = stored(classes.select("class", "low", "rep", "rep.n_shingles", "rep.registers"), "classes")
    found = components(class_links(classes, texts, k, percent))
    low = classes.select("class", "low")
    linked = found.join(low, found["node"] == low["class"])
    least = stored(linked.groupBy("component").agg(F.min("low").alias("least")), "least")
    linked = stored(found.join(least, "component").select(F.col("node").alias("class"), "component", "least"), "linked")
    ids = low.join(linked, "class", "left").select("class", F.coalesce("component", "class").alias("component"), F.coalesce("least", "low").alias("component_id"))
    ids = stored(ids, "ids")
    out = rows.drop("registers").join(ids, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "text_hash", "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_near_dups(spark, sf_dir) -> DataFrame:
    """Components of all documents at 0.8 over two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=2).drop("text_hash", "component")
