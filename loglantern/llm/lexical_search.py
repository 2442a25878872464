"""Ranked lexical search of all items over all documents by two trees at once.

An item is a vector of term weights, a document a vector of saturated term counts, a score their product. Documents that
share their rarest asked-for terms are brought together by a range shuffle; each task packs them into leaves, and
leaves into nodes, that hold the highest value of every term below them. Items are packed in the same way. The product of two
nodes' highest values bounds every score of their pairs, so a pair of nodes is dropped when its bound is below the weakest
k-th score that the items of the one have so far; equal bounds are followed, as a smaller id may win a tie. What is left
at the leaves is scored exactly. A first round takes, for each leaf of items, the document leaf of the highest bound in each
task; its k-th scores over all documents are true lower limits and open the second round, which visits all that may beat them.

Items go through in chunks whose terms have a bounded size, whatever the number of items; documents are read as
vectors over the terms of a chunk only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglantern.llm.tables import parts, table
from loglantern.llm.words import _BYTE_VALUE, _LOWER, blocks, mixed, powers
from loglantern.plans.scratch import stored

TOP = 50
#: Bytes of the texts of a chunk of items; a longer item is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Items and documents of a leaf, and children of a node.
ITEM_LEAF, DOC_LEAF, FAN = 8, 64, 8
#: Documents that one tree holds.
TREE_DOCS = 4096
#: Fixed values of the score.
UNIT, SATURATION, LENGTH_SCALE, BASE, SLOPE = 1_000_000_000, 1000, 20, 50, 50

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_IN_TERM = np.array([bool(TERM.fullmatch(bytes([b]))) for b in range(256)])


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash a term, of its bytes alone."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power[:-1], dtype=np.uint64, out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start])


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the terms of a block of texts in order, and where each text's begin; A-Z lower-cased."""
    data = _LOWER[data]
    inside = _IN_TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = bounds[:-1][(bounds[:-1] > 0) & (bounds[:-1] < len(data))]  # a text's end ends a term
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return (_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)), np.searchsorted(start, bounds)


@dataclass
class Items:
    """A chunk of items: `terms` sorted hashes of all their terms; item i asks for the numbers of[first[i]:first[i + 1]] of them."""

    keys: list
    terms: np.ndarray
    of: np.ndarray
    first: np.ndarray

    @classmethod
    def read(cls, rows: list) -> Items:
        """From (key, text) rows; an item's terms count once."""
        raw = [(text or "").encode() for _, text in rows]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        hashes, first = terms_of(np.frombuffer(b"".join(raw), np.uint8), bounds)
        own = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:], strict=False)]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        sizes = np.concatenate(([0], np.cumsum([len(o) for o in own]))).astype(np.int64)
        return cls([k for k, _ in rows], terms, np.searchsorted(terms, np.concatenate([np.zeros(0, np.uint64), *own])), sizes)

    def __len__(self) -> int:
        return len(self.keys)


_VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])


def _vector_rows(terms: np.ndarray):
    """Each text's number of terms, and which of the given terms it has, how often."""

    def rows(batches):
        for batch, texts in blocks(batches):
            hashes, first = terms_of(texts.data, texts.bounds)
            at = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
            known = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
            of = np.repeat(np.arange(len(texts)), np.diff(first))[known]
            pair, tf = np.unique(of * np.int64(len(terms) + 1) + at[known], return_counts=True)
            of, term = np.divmod(pair, len(terms) + 1)
            offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (term.astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64)), *lists], schema=_VECTOR)

    return rows


def _near_rows(rank: np.ndarray):
    """Add each document's three rarest terms, as ranks by rarity."""

    def rows(batches):
        for batch in batches:
            lists = batch.column(2)
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            ranks = rank[lists.flatten().to_numpy(zero_copy_only=False)]
            order = np.lexsort((ranks, of))
            of, ranks = of[order], ranks[order]
            first = np.arange(len(of)) - np.searchsorted(of, of) < 3
            offsets = pa.array(np.searchsorted(of[first], np.arange(batch.num_rows + 1)).astype(np.int32))
            near = pa.ListArray.from_arrays(offsets, pa.array(ranks[first].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], names=[*batch.schema.names, "near"])

    return rows


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Tree:
    """Nodes over vectors in the order given: per level the highest value of every term below each node; level 0 holds the leaves.

    Values are whole numbers. They are kept as doubles as long as no product's sum reaches 2**53, so products are exact."""

    def __init__(self, n: int, n_terms: int, of: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int, dtype):
        self.n, self.leaf = n, leaf
        low = np.zeros((-(-n // leaf), n_terms), dtype)
        np.maximum.at(low, (of // leaf, term), value.astype(dtype))
        self.levels = [low]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    @property
    def top(self) -> int:
        return len(self.levels) - 1

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min(len(self.levels[level - 1]), (node + 1) * FAN))

    def members(self, node: int) -> slice:
        return slice(node * self.leaf, min(self.n, (node + 1) * self.leaf))


@dataclass
class Query:
    """What a task needs of a chunk: the items in tree order, their weights, and the lengths that scores depend on."""

    of: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    n: int
    n_terms: int
    n_docs: int
    total: int
    k: int
    dtype: type

    @classmethod
    def of_items(cls, items: Items, weight: np.ndarray, n_docs: int, total: int, k: int) -> tuple[Query, list[int]]:
        """The query, and the item numbers in its order: items that share their rarest terms are neighbours."""
        rarest = []
        for i in range(len(items)):
            own = items.of[items.first[i] : items.first[i + 1]]
            rarest.append(tuple(own[np.lexsort((own, -weight[own]))][:3].tolist()))
        order = sorted(range(len(items)), key=lambda i: (rarest[i], i))
        own = [items.of[items.first[i] : items.first[i + 1]] for i in order]
        term = np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64)
        of = np.repeat(np.arange(len(order)), [len(o) for o in own])
        most = max((int(weight[o].sum()) for o in own), default=0) * (UNIT // SATURATION)
        dtype = np.float64 if most < 2**53 else np.int64
        return cls(of, term, weight[term], len(order), len(weight), n_docs, total, k, dtype), order

    def tree(self) -> Tree:
        return Tree(self.n, self.n_terms, self.of, self.term, self.weight, ITEM_LEAF, self.dtype)

    def values(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a term that occurs tf times among a document's n adds for each unit of its weight."""
        if self.n_docs * int(n.max(initial=0)) * SLOPE >= 2**63:
            share = np.array([SLOPE * x * self.n_docs // self.total for x in n.tolist()], np.int64)
        else:
            share = SLOPE * n * self.n_docs // max(1, self.total)
        return UNIT * tf // (SATURATION * tf + LENGTH_SCALE * (BASE + share))


class Search:
    """The best k documents of each item so far; documents come in trees of some thousands."""

    def __init__(self, query: Query, limits: np.ndarray | None = None):
        self.q, self.items = query, query.tree()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(query.n)]
        self.limit = np.ones(query.n, query.dtype) if limits is None else np.maximum(limits, 1).astype(query.dtype)
        self.visited = self.pairs = 0
        #: per node of items: the terms it has, so that bounds are products over these alone
        self.seen = [[np.flatnonzero(row) for row in level] for level in self.items.levels]
        dense = np.zeros((query.n, query.n_terms), query.dtype)
        dense[query.of, query.term] = query.weight
        self.dense = [dense[self.items.members(i)][:, self.seen[0][i]].T.copy() for i in range(len(self.items.levels[0]))]

    def bounds(self, level: int, node: int, values: np.ndarray) -> np.ndarray:
        """The bound of a node of items with each node of documents."""
        terms = self.seen[level][node]
        return values[:, terms] @ self.items.levels[level][node, terms]

    def weakest(self, level: int, node: int):
        """The lowest limit of the items below a node."""
        size = ITEM_LEAF * FAN**level
        return self.limit[node * size : (node + 1) * size].min()

    def add(self, ids: np.ndarray, n: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray, first_only: bool) -> None:
        """Search a tree of documents. With first_only, each leaf of items sees its most promising leaf of them alone."""
        q = self.q
        value = q.values(n[of], tf)
        docs = Tree(len(ids), q.n_terms, of, term, value, DOC_LEAF, q.dtype)
        dense = np.zeros((len(ids), q.n_terms), q.dtype)
        dense[of, term] = value
        if first_only:
            for i in range(len(self.items.levels[0])):
                bound = self.bounds(0, i, docs.levels[0])
                d = int(bound.argmax())
                if bound[d] >= self.weakest(0, i):
                    self.score(i, d, docs, dense, ids)
            return
        self.pairs += len(self.items.levels[0]) * len(docs.levels[0])
        start = self.bounds(self.items.top, 0, docs.levels[-1])[0]
        stack = [(self.items.top, 0, docs.top, 0, start)]
        while stack:
            a, i, b, d, bound = stack.pop()
            if bound < self.weakest(a, i):
                continue
            if a == b == 0:
                self.visited += 1
                self.score(i, d, docs, dense, ids)
            elif a and (a >= b or not b):  # the taller tree goes down first
                for child in self.items.children(a, i):
                    stack.append((a - 1, child, b, d, self.bounds(a - 1, child, docs.levels[b][d : d + 1])[0]))
            else:
                own = docs.children(b, d)
                found = self.bounds(a, i, docs.levels[b - 1][own.start : own.stop])
                for j in np.argsort(found, kind="stable"):  # the highest bound is taken up next
                    stack.append((a, i, b - 1, own.start + int(j), found[j]))

    def score(self, i: int, d: int, docs: Tree, dense: np.ndarray, ids: np.ndarray) -> None:
        """Score a leaf of items with one of documents and keep the best."""
        rows, own = docs.members(d), self.items.members(i)
        scores = dense[rows][:, self.seen[0][i]] @ self.dense[i]
        for j, item in enumerate(range(own.start, own.stop)):
            at = np.flatnonzero(scores[:, j] >= self.limit[item])
            if not len(at):
                continue
            score = np.concatenate([self.best[item][0], scores[at, j].astype(np.int64)])
            who = np.concatenate([self.best[item][1], ids[rows][at]])
            order = np.lexsort((who, -score))[: self.q.k]
            self.best[item] = score[order], who[order]
            if len(order) == self.q.k:
                self.limit[item] = max(self.limit[item], score[order[-1]])


_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("visited", pa.int64()), ("pairs", pa.int64())])
#: No id comes last among equal scores.
_NO_ID = np.iinfo(np.int64).max


def _search_rows(query: Query, limits: np.ndarray | None, first_only: bool):
    def rows(batches):
        search = Search(query, limits)
        waiting, count = [], 0

        def flush():
            ids = np.concatenate([w[0] for w in waiting])
            n = np.concatenate([w[1] for w in waiting])
            size = np.concatenate([w[2] for w in waiting])
            term, tf = (np.concatenate([w[c] for w in waiting]) for c in (3, 4))
            search.add(ids, n, np.repeat(np.arange(len(ids)), size), term, tf, first_only)

        for batch in batches:
            for at in range(0, batch.num_rows, TREE_DOCS):
                part = batch.slice(at, TREE_DOCS)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3)]
                waiting.append((ids, part.column(1).to_numpy(), size, flat[0].astype(np.int64), flat[1].astype(np.int64)))
                count += part.num_rows
                if count >= TREE_DOCS:
                    flush()
                    waiting, count = [], 0
        if count:
            flush()
        item = np.repeat(np.arange(query.n), [len(b[0]) for b in search.best]).astype(np.int32)
        score, who = (np.concatenate([np.zeros(0, np.int64), *(b[c] for b in search.best)]) for c in (0, 1))
        told = [pa.array(np.concatenate([np.full(min(1, len(item)), v), np.zeros(max(0, len(item) - 1))]).astype(np.int64)) for v in (search.visited, search.pairs)]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(who, pa.int64(), mask=who == _NO_ID), pa.array(score), *told], schema=_FOUND)

    return rows


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each item: of a part of its finds first, so that no task has all of an item's."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _item_chunks(items: DataFrame, chunk_bytes: int):
    """Items (item_id, text), rows equal in both once, as lists of bounded size, one at a time."""
    rows = items.select("item_id", "text").dropDuplicates().withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = stored(rows, "items")
    total = rows.agg(F.sum(F.col("bytes") + 16).alias("n")).first()["n"] or 0
    chunks = max(1, -(-total // chunk_bytes))
    for c in range(chunks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).orderBy("item_id", "text")
        yield [(r["item_id"], r["text"]) for r in own.toLocalIterator()]


def ranked(items: DataFrame, docs: DataFrame, k: int = TOP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending doc_id.

    items: item_id, text; docs: doc_id, text; other columns are ignored. Null texts have no terms. Items equal in id and text are
    one; rows of docs are documents of their own, also when they are equal; no id comes last among equal scores. Without
    documents or items the result is empty. `visited` and `pairs` (of leaves) tell how much was searched."""
    spark = docs.sparkSession
    out = None
    for rows in _item_chunks(items, chunk_bytes):
        found = _ranked_chunk(spark, Items.read(rows), rows, docs, k)
        out = found if out is None else out.unionByName(found)
    return out


def _ranked_chunk(spark: SparkSession, items: Items, rows: list, docs: DataFrame, k: int) -> DataFrame:
    keys = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "number int, item_id long")
    vectors = docs.select("doc_id", "text").mapInArrow(_vector_rows(items.terms), "doc_id long, n long, term array<int>, tf array<long>")
    vectors = stored(vectors, "term-vectors")
    size = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total")).first()
    held = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row for each term of the chunk
    df = np.zeros(len(items.terms), np.int64)
    for r in held:
        df[r["term"]] = r["df"]
    weight = weights(df, size["docs"]) * (df > 0)
    query, order = Query.of_items(items, weight, size["docs"], size["total"] or 0, k)

    # documents by their rarest terms, so that a leaf's documents ask for the same items
    by_rarity = np.empty(len(weight), np.int64)
    by_rarity[np.lexsort((np.arange(len(weight)), -weight))] = np.arange(len(weight))
    keyed = vectors.where(F.size("term") > 0).mapInArrow(_near_rows(by_rarity), "doc_id long, n long, term array<int>, tf array<long>, near array<int>")
    keyed = keyed.repartitionByRange(parts(spark), "near", "n", "doc_id").sortWithinPartitions("near", "n", "doc_id").drop("near")
    placed = stored(keyed, "placed-vectors")

    schema = "item int, doc_id long, score long, visited long, pairs long"
    first = _top(placed.mapInArrow(_search_rows(query, None, True), schema), k)
    limits = np.zeros(query.n, np.int64)
    for r in first.where(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the chunk
        limits[r["item"]] = r["score"]
    found = stored(placed.mapInArrow(_search_rows(query, limits, False), schema), "finds")
    best = _top(found, k)
    numbers = spark.createDataFrame([(i, n) for i, n in enumerate(order)], "item int, number int")
    named = best.join(numbers, "item").join(keys, "number")
    return stored(named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "visited", "pairs"), "ranked")


def op12_lexical_search(spark, sf_dir) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return ranked(table(spark, sf_dir, "benchmark", "item_id", "text"), docs).select("item_id", "rank", "doc_id", "score")
