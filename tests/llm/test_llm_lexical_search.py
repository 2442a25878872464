"""Ranked search against a plain scoring of all pairs, and the bounds that prune."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from plain import DOCS, corpus
from pyspark.sql import functions as F

from loglantern.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(items, docs, k=50):
    own = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(1 for c in own if c), sum(sum(c.values()) for c in own)
    df = Counter(t for c in own for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        found = []
        for (doc_id, _), c in zip(docs, own, strict=True):
            n, score = sum(c.values()), 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 20 * (100 - 50 + 50 * n * n_docs // total)))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, items, docs):
    rows = [(i, t, "en", "s", 0) for i, t in docs]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "term", "source": "tf"}).repartition(3)
    return spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x")), docs


def odd():
    docs = [(r[0], r[1]) for r in corpus(3, 90)]
    docs += [(2000 + i, "hot copy kan lor") for i in range(120)] + [(3000 + i, "lor " * (i + 1)) for i in range(70)]
    docs += [(9, "hot copy kan lor")] * 3 + [(None, "hot hot"), (4000, "kan,LOR;é_中文-x9" * 4000), (4001, "é" * 30_000), (4002, "---")]
    items = [(i, r[1]) for i, r in enumerate(corpus(3, 40)[:30])]
    items += [(100, "hot"), (101, "copy KAN copy"), (102, "nobody has this"), (103, None), (104, ""), (105, "x9 É é 中文"), (105, "lor"), (106, "lor"), (106, "lor")]
    return items + [(None, "kan")], docs


@pytest.mark.parametrize("k,chunk", [(50, ls.CHUNK_BYTES), (3, 3000)])
def test_against_plain(spark, k, chunk):
    items, docs = odd()
    got = ls.ranked(*tables(spark, items, docs), k, chunk).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(items, docs, k)


def test_small_trees_prune_and_stay_exact(spark, monkeypatch):
    rng = random.Random(2)
    groups = [[f"w{g}x{i}" for i in range(12)] for g in range(40)]
    docs = [(i, " ".join(rng.choices(groups[i % 40], k=rng.randrange(5, 40)))) for i in range(2000)]
    items = [(g, " ".join(groups[g][:4])) for g in range(0, 40, 2)]
    want = plain(items, docs, 5)
    found = ls.ranked(*tables(spark, items, docs), 5).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str) == want
    pairs, visited = (sum(r[c] for r in found) for c in ("pairs", "visited"))
    assert visited <= pairs


def test_search_visits_few_leaves():
    """Clustered documents: pairs of leaves without a common term are never scored."""
    rng = np.random.default_rng(1)
    n, n_terms = 4096, 320
    group = np.sort(rng.integers(0, 64, n))
    term = (group[:, None] * 5 + np.arange(5)).reshape(-1)
    tf = rng.integers(1, 9, n * 5)
    of = np.repeat(np.arange(n), 5)
    items = ls.Items(list(range(64)), np.arange(n_terms, dtype=np.uint64), np.arange(n_terms), np.arange(0, n_terms + 1, 5))
    weight = np.full(n_terms, 900)
    query, order = ls.Query.of_items(items, weight, n, n * 25, 10)
    search = ls.Search(query)
    search.add(np.arange(n), np.full(n, 25), of, term, tf, False)
    value = query.values(np.full(n * 5, 25), tf)
    dense = np.zeros((n, n_terms), np.int64)
    dense[of, term] = value
    for at, item in enumerate(order):
        score = dense[:, item * 5 : item * 5 + 5].sum(axis=1) * 900
        want = np.lexsort((np.arange(n), -score))[:10]
        assert search.best[at][0].tolist() == score[want].tolist() and search.best[at][1].tolist() == want.tolist()
    assert search.visited < search.pairs / 2


def test_nothing(spark):
    items, docs = tables(spark, [(1, "a")], [])
    assert ls.ranked(items, docs).collect() == []
    items, docs = tables(spark, [], [(1, "a")])
    assert ls.ranked(items, docs).collect() == []
