"""Near duplicates among embeddings, by hierarchical navigable small-world graphs.

Vectors are compared within a label. Equal vectors are one class. The classes of a label are dealt into shards of
bounded size, and each shard builds its graph: a node's layers are drawn from its id, its links on each layer are the
best of a beam search that are nearer to it than to each other. Then every vector queries every shard of its
label, whole shards at a time: a task holds two shards and runs the queries of each against the graph of the other.
A beam widens for a query while even its last member is a match; and for all queries when an audit of a sample
against all vectors of the shard finds a link that neither of its ends has found. Matches are verified by cosine in
double precision and counted; a task hands on one link for each vector of what it has joined, so that large groups cost no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.components import components
from loglantern.llm.tables import table
from loglantern.llm.words import mixed
from loglantern.plans.scratch import stored

MIN_COSINE = 0.93
#: Vectors of a shard, about.
SHARD_VECTORS = 6000
LINKS = 16
BUILD_BEAM, QUERY_BEAM = 64, 64
#: Nodes that a search opens at once (more in wide beams), and queries that run side by side.
OPENED, TOGETHER = 4, 512
#: A beam of more than so much of a shard looks at all of it.
WHOLE = 0.25
#: An audit looks at one in so many queries; two in a row must pass.
AUDIT_SHARE, AUDITS = 8, 2
_SLACK = 1e-4  # of a search in single precision


@dataclass
class Graph:
    """Unit vectors (single precision), and for each layer the links of its nodes; -1 is none."""

    vectors: np.ndarray
    layers: list[np.ndarray]
    entry: int

    def search(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nodes (best first, -1 for none) and cosines for each query, from its entries."""
        q, n, links = len(queries), len(self.vectors), self.layers[layer]
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)[:, None]
        ids = entries.copy()
        seen[rows, np.maximum(ids, 0)] = ids >= 0
        score = np.where(ids >= 0, np.einsum("qd,qed->qe", queries, self.vectors[np.maximum(ids, 0)]), -np.inf).astype(np.float32)
        opened = ids < 0
        live = np.arange(q)
        best_ids, best_score = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf, np.float32)
        while True:
            order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            ids, score, opened = (np.take_along_axis(x, order, 1) for x in (ids, score, opened))
            more = ~opened.all(axis=1)
            if not more.all():
                done = live[~more]
                best_ids[done, : ids.shape[1]], best_score[done, : ids.shape[1]] = ids[~more], score[~more]
                live, ids, score, opened = live[more], ids[more], score[more], opened[more]
                if not len(live):
                    return best_ids, best_score
            pick = np.argsort(opened, axis=1, kind="stable")[:, : max(OPENED, beam // 16)]  # unopened ones first, in order of score
            fresh = ~np.take_along_axis(opened, pick, 1)
            np.put_along_axis(opened, pick, True, 1)
            near = np.where(fresh[:, :, None], links[np.maximum(np.take_along_axis(ids, pick, 1), 0)], -1).reshape(len(live), -1)
            ok = near >= 0
            at = np.maximum(near, 0)
            ok &= ~seen[live[:, None], at]
            # a node that two of the opened ones name counts once
            sort = np.argsort(np.where(ok, at, n), axis=1, kind="stable")
            at, ok = np.take_along_axis(at, sort, 1), np.take_along_axis(ok, sort, 1)
            ok[:, 1:] &= ~((at[:, 1:] == at[:, :-1]) & ok[:, :-1])
            r, c = np.nonzero(ok)
            seen[live[r], at[r, c]] = True
            new = np.full(at.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("kd,kd->k", queries[live[r]], self.vectors[at[r, c]])
            ids = np.concatenate([ids, np.where(ok, at, -1)], axis=1)
            score = np.concatenate([score, new], axis=1)
            opened = np.concatenate([opened, ~ok], axis=1)

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """For each query the nodes from which to enter the layer `down_to`."""
        at = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.layers) - 1, down_to, -1):
            at, _ = self.search(queries, at, layer, 4)
        return at


def _levels(ids: np.ndarray) -> np.ndarray:
    u = (mixed(ids.astype(np.uint64)) >> np.uint64(11)).astype(float) / 2**53
    return np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(int), 8)


def _diverse(vectors: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's nodes, best first: those nearer to the row's vector than to any taken before, then the best of the others; -1 fills up."""
    inner = np.einsum("red,rfd->ref", vectors[np.maximum(ids, 0)], vectors[np.maximum(ids, 0)])
    taken = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        nearest = np.where(taken[:, :k], inner[:, k, :k], -np.inf).max(axis=1, initial=-np.inf)
        taken[:, k] = (ids[:, k] >= 0) & (score[:, k] >= nearest) & (taken[:, :k].sum(axis=1) < most)
    order = np.argsort(np.where(ids < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


def built(vectors: np.ndarray, ids: np.ndarray) -> Graph:
    """A graph over unit vectors; nodes come in by batches that grow with the graph."""
    n = len(vectors)
    level = _levels(ids)
    order = np.lexsort((mixed(ids.astype(np.uint64)), -level))  # upper layers first, so that they route all later nodes
    wide = [2 * LINKS if k == 0 else LINKS for k in range(level.max() + 1)]
    graph = Graph(vectors, [np.full((n, w), -1, np.int64) for w in wide], int(order[0]))
    at = 1
    while at < n:
        batch = order[at : at + max(1, min(at, 256))]
        at += len(batch)
        queries = vectors[batch]
        entries = np.full((len(batch), 1), graph.entry)
        for layer in range(len(wide) - 1, -1, -1):
            here = level[batch] >= layer
            ids_, score = graph.search(queries, entries, layer, BUILD_BEAM if here.any() else 4)
            entries = ids_
            if not here.any():
                continue
            new = batch[here]
            inside = queries[here] @ queries[here].T  # nodes of one batch find each other here
            inside[np.arange(len(new))[:, None] <= np.arange(len(new))[None, :]] = -np.inf
            k = min(len(new), LINKS)
            peers = np.argsort(-inside, axis=1, kind="stable")[:, :k]
            peer_score = np.take_along_axis(inside, peers, 1)
            pool = np.concatenate([ids_[here], np.where(np.isfinite(peer_score), new[peers], -1)], axis=1)
            pool_score = np.concatenate([score[here], peer_score], axis=1)
            best = np.argsort(-pool_score, axis=1, kind="stable")[:, :BUILD_BEAM]
            chosen = _diverse(vectors, np.take_along_axis(pool, best, 1), np.take_along_axis(pool_score, best, 1), LINKS)
            table_ = graph.layers[layer]
            table_[new, : chosen.shape[1]] = chosen
            _link_back(vectors, table_, new, chosen)
    return graph


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add each new node to the links of those it chose; full lists keep the diverse best."""
    source, target = np.repeat(new, chosen.shape[1]), chosen.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    more = np.full((len(nodes), count.max()), -1, np.int64)
    more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    pool = np.concatenate([links[nodes], more], axis=1)
    order = np.argsort(pool < 0, axis=1, kind="stable")
    pool = np.take_along_axis(pool, order, 1)
    wide = links.shape[1]
    over = (pool >= 0).sum(axis=1) > wide
    links[nodes[~over]] = pool[~over, :wide]
    for at in range(0, over.sum(), 256):
        rows = np.flatnonzero(over)[at : at + 256]
        own = pool[rows]
        score = np.where(own >= 0, np.einsum("rd,rpd->rp", vectors[nodes[rows]], vectors[np.maximum(own, 0)]), -np.inf).astype(np.float32)
        best = np.argsort(-score, axis=1, kind="stable")
        links[nodes[rows]] = _diverse(vectors, np.take_along_axis(own, best, 1), np.take_along_axis(score, best, 1), wide)


def matches(graph: Graph, exact: np.ndarray, queries: np.ndarray, cosine: float, beam: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of verified matches by a beam that widens for each query until its last member is none.

    queries and exact are unit vectors in double precision; own: they are the same, and each query enters at itself too."""
    n, found, single = len(exact), [], queries.astype(np.float32)
    for a in range(0, len(queries), TOGETHER):
        todo, width = np.arange(a, min(a + TOGETHER, len(queries))), beam
        while len(todo):
            if width >= WHOLE * n:  # all of the shard is in the beam
                r, c = np.nonzero(single[todo] @ graph.vectors.T >= cosine - _SLACK)
                found.append(_verified(todo[r], c, queries, exact, cosine))
                break
            entries = graph.descend(single[todo], 0)
            if own:
                entries = np.concatenate([np.where(entries == todo[:, None], -1, entries), todo[:, None]], axis=1)
            ids, score = graph.search(single[todo], entries, 0, width)
            close = (ids >= 0) & (score >= cosine - _SLACK)
            full = close[:, -1]  # even the last of the beam matches
            r, c = np.nonzero(close & ~full[:, None])
            found.append(_verified(todo[r], ids[r, c], queries, exact, cosine))
            todo, width = todo[full], width * 4
    return _joined(found)


def all_matches(a: tuple[Graph, np.ndarray], b: tuple[Graph, np.ndarray] | None, cosine: float, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of all linked pairs of one shard, or between two, each in both directions; b's vectors are numbered after a's.

    A pair counts when either finds the other. Audits compare a sample of the vectors with all of the other shard; a
    link that is missed doubles the beam, until two audits in a row pass or the beam holds a whole shard."""
    beam, passed, round_, size = QUERY_BEAM, 0, 0, len(a[1])
    exact = a[1] if b is None else np.concatenate([a[1], b[1]])
    while True:
        if b is None:
            query, node = matches(*a, a[1], cosine, beam, own=True)
        else:
            (q1, n1), (q2, n2) = matches(*b, a[1], cosine, beam), matches(*a, b[1], cosine, beam)
            query, node = np.concatenate([q1, n2]), np.concatenate([n1 + size, q2 + size])
        pair = np.unique(np.concatenate([query * len(exact) + node, node * len(exact) + query]))
        query, node = pair // len(exact), pair % len(exact)
        if beam >= WHOLE * max(size, len(exact) - size):
            return query, node
        sample = mixed(ids.astype(np.uint64) + np.uint64(round_ << 40)) % np.uint64(AUDIT_SHARE) == 0
        truth = 0
        for part, other in ([(np.flatnonzero(sample), exact)] if b is None else [(np.flatnonzero(sample[:size]), b[1]), (size + np.flatnonzero(sample[size:]), a[1])]):
            truth += sum(int((exact[part[at : at + TOGETHER]] @ other.T >= cosine).sum()) for at in range(0, len(part), TOGETHER))
        round_ += 1
        if truth <= int(sample[query].sum()):
            passed += 1
            if passed >= AUDITS:
                return query, node
            beam = beam * 3 // 2
        else:
            passed, beam = 0, beam * 2


def _joined(found):
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _verified(query, node, queries, exact, cosine):
    ok = np.concatenate([np.einsum("kd,kd->k", queries[query[a : a + 65536]], exact[node[a : a + 65536]]) >= cosine for a in range(0, len(query), 65536)]) if len(query) else np.zeros(0, bool)
    return query[ok], node[ok]


def _unit(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.sqrt(np.einsum("nd,nd->n", flat, flat))[:, None]


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("id").combine_chunks()
    graph = built(_unit(rows.column("embedding")).astype(np.float32), rows.column("id").to_numpy())
    top = np.arange(len(rows)) == graph.entry
    # a node's links: those of all layers in a row; every node of a shard has as many
    links = np.concatenate(graph.layers, axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * links.shape[1]), pa.array(links.reshape(-1).astype(np.int32)))
    return rows.append_column("links", lists).append_column("entry", pa.array(top))


def _graph(rows: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.sort_by("id").combine_chunks()
    exact = _unit(rows.column("embedding"))
    links = rows.column("links").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(np.int64)
    cuts = [0, 2 * LINKS, *range(3 * LINKS, links.shape[1] + 1, LINKS)]
    layers = [links[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    entry = int(np.flatnonzero(rows.column("entry").to_numpy(zero_copy_only=False))[0])
    return Graph(exact.astype(np.float32), layers, entry), exact, rows.column("id").to_numpy(), rows.column("n").to_numpy()


def _compare(cosine: float):
    def rows(key: tuple, both: pa.Table) -> pa.Table:
        low, high = key[-2].as_py(), key[-1].as_py()
        shard = both.column("shard").to_numpy()
        a = _graph(both.filter(pa.array(shard == low)))
        if low == high:
            ids, n = a[2], a[3]
            x, y = all_matches(a[:2], None, cosine, ids)
        else:
            if not (shard == high).any() or not (shard == low).any():
                return _EMPTY
            b = _graph(both.filter(pa.array(shard == high)))
            ids, n = np.concatenate([a[2], b[2]]), np.concatenate([a[3], b[3]])
            x, y = all_matches(a[:2], b[:2], cosine, ids)
        x, y = x[x != y], y[x != y]
        links = np.bincount(x, n[y], len(ids)).astype(np.int64)
        least = ids.copy()
        while True:  # the least id that each reaches here
            new = least.copy()
            np.minimum.at(new, x, least[y])
            new = np.minimum(new, new[np.searchsorted(ids, new)]) if (np.diff(ids) > 0).all() else new
            if (new == least).all():
                break
            least = new
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "least": least[some]}, schema=_EMPTY.schema)

    return rows


_EMPTY = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())]).empty_table()


def vector_links(vectors: DataFrame, cosine: float = MIN_COSINE, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Links join vectors of one label and length whose cosine is `cosine` or more. Rows whose label or vector is null, whose
    vector is empty or zero, or has a null or non-finite component, link with nothing. Repeated rows are vectors
    of their own. Rows need a vec_id to link. Other columns are left behind."""
    rows = vectors.select("vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    rows = stored(rows.withColumn("good", good), "vectors")
    classes = rows.filter("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("size", F.size("embedding")), "classes")
    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("count")).withColumn("shards", F.ceil(F.col("count") / shard_vectors).cast("int")).drop("count")
    dealt = classes.join(stored(sizes, "shards"), ["label", "size"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).select("label", "size", "shards", "shard", "id", "n", "embedding")
    graph_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", links array<int>, entry boolean"
    graphs = stored(dealt.groupBy("label", "size", "shard").applyInArrow(_build, graph_schema), "graphs")
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    pairs = graphs.select("*", other).withColumns({"low": F.least("shard", "other"), "high": F.greatest("shard", "other")}).drop("other", "shards")
    found = pairs.groupBy("label", "size", "low", "high").applyInArrow(_compare(cosine), "id long, links long, least long")
    found = stored(found, "found")
    joined = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.filter("good").join(stored(named, "named"), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_vector_links(spark, sf_dir) -> DataFrame:
    """Links and components of all embeddings."""
    return vector_links(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
