import random
from collections import Counter

import numpy as np
import pytest
from plain import components
from pyspark.sql import functions as F

from loglantern.llm import vector_links as vl

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(seed, n, dims=16, spread=0.28):
    dice = np.random.default_rng(seed)
    centres = dice.standard_normal((n // 6, dims))
    rows = []
    for i in range(n):
        v = centres[dice.integers(len(centres))] + dice.standard_normal(dims) * spread * dice.random()
        rows.append((i * 3, [float(np.float32(x)) for x in v], int(dice.integers(3))))
    return rows


def expected(rows, cosine=0.93):
    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])

    ok = [i for i, r in enumerate(rows) if fine(r)]
    links, pairs = Counter(), []
    for a in range(len(ok)):
        for b in range(a):
            x, y = rows[ok[a]], rows[ok[b]]
            if x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine:
                    links[ok[a]] += 1
                    links[ok[b]] += 1
                    pairs.append((ok[a], ok[b]))
    found, least = components(range(len(rows)), pairs), {}
    for i in ok:
        least[found[i]] = min(least.get(found[i], 10**9), rows[i][0])
    return [(r[0], links[i], least[found[i]] if i in ok else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("shard", [6000, 40])
def test_against_all_pairs(spark, shard):
    rows = clusters(1, 260)
    rng = random.Random(2)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(60)]  # copies
    rows += [(1100, None, 1), (1101, [0.0] * 16, 1), (1102, [1.0, None], 1), (1103, [float("nan")] * 16, 1), (1104, [float("inf")] * 16, 1)]
    rows += [(1105, rows[0][1], None), (1106, [], 1), (1107, [1.0, 0.0], 1), (1108, [2.0, 0.0], 1), rows[7], (None, rows[7][1], rows[7][2])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "shard": F.lit(2)}).repartition(3)
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in vl.vector_links(df, shard_vectors=shard).collect())
    want = sorted((a if a is not None else -1, n, c if c is not None else -1) for a, n, c in expected(rows))
    assert got == want
    assert len({c for _, n, c in want if n}) > 5


def test_empty_table(spark):
    assert vl.vector_links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_graph_recall_and_widening():
    dice = np.random.default_rng(3)
    centres = dice.standard_normal((200, 32))
    x = np.repeat(centres, 10, axis=0) + dice.standard_normal((2000, 32)) * 0.12
    x = np.concatenate([x, centres[:1] + dice.standard_normal((700, 32)) * 0.05])  # a group larger than any first beam
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = vl.built(x.astype(np.float32), np.arange(len(x)))
    truth = x @ x.T >= 0.93
    query, node = vl.all_matches((graph, x), None, 0.93, np.arange(len(x)))
    found = np.zeros_like(truth)
    found[query, node] = True
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.9999 * truth.sum()
    a, b = np.arange(0, len(x), 2), np.arange(1, len(x), 2)
    halves = [(vl.built(x[p].astype(np.float32), p), x[p]) for p in (a, b)]
    query, node = vl.all_matches(*halves, 0.93, np.concatenate([a, b]))
    got = np.zeros_like(truth)
    got[np.concatenate([a, b])[query], np.concatenate([a, b])[node]] = True
    assert got[np.ix_(a, b)].sum() >= 0.9999 * truth[np.ix_(a, b)].sum() and (got == got.T).all() and not (got & ~truth).any()
    # the graph alone, one narrow beam, gives most of the nearest ten
    ids, _ = graph.search(x[:300].astype(np.float32), graph.descend(x[:300].astype(np.float32), 0), 0, 64)
    near = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids[:, :10], near)]) > 0.9
