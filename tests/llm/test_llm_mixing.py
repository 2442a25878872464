from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import DOCS, corpus, prose, targets, words
from pyspark.sql import functions as F

from loglantern.llm import mixing


def mix(docs, **options):
    placed, spans = mixing.mix_spans(mixing.sized(docs), **options)
    return placed.collect(), spans.collect()


def sources_of(spark, sizes, weights):
    rows = [(i, n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights, strict=False))]
    return spark.createDataFrame(rows, "source_number long, source_size long, weight double")


@pytest.mark.parametrize(
    "sizes, weights, total",
    [
        ([100, 100, 100], [5, 2, 1], 240), ([100, 10, 100], [1, 5, 1], 120), ([10, 10, 1000], [5, 2, 1], 1530), ([10, 0, 5], [5, 2, 1], 1e9),
        ([], [], 0), ([0, 0], [5, 2], 0), ([2**i for i in range(12)], [5, 2, 1] * 4, 1.5 * (2**12 - 1)),
    ],
)
def test_targets(spark, sizes, weights, total):
    found = mixing.target_table(sources_of(spark, sizes, weights), total).orderBy("source_number").collect()
    assert [r["target"] for r in found] == pytest.approx(targets(sizes, weights, total))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    got = mixing.permuted(np.arange(n), n, 99)
    assert sorted(got) == list(range(n))
    if n > 900:
        assert abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.1
        assert (got != mixing.permuted(np.arange(n), n, 100)).any()


def plain_draws(slots, shard_slots, seed):
    """The draws of all shards, one after the other: {(shard, source): (first slot, slots)}. As many sources as one node holds."""
    out, used, total = {}, [0] * len(slots), sum(slots)
    own = [s for s, n in enumerate(slots) if n]
    weights = np.array([slots[s] for s in own], float)
    shards = -(-total // shard_slots)
    for shard in range(shards):
        n = min(shard_slots, total - shard * shard_slots)
        counts = np.random.Generator(np.random.PCG64([seed, 0, 0, shard])).multinomial(n, weights / weights.sum())
        for s, k in zip(own, counts.tolist(), strict=True):
            k = min(k, slots[s] - used[s])
            if k:
                out[shard, s] = (used[s], k)
                used[s] += k
    spot = 0
    for s in own:
        while used[s] < slots[s]:
            k = min(slots[s] - used[s], shard_slots - spot % shard_slots)
            out[shards + spot // shard_slots, s] = (used[s], k)
            used[s], spot = used[s] + k, spot + k
    return out


def draws_of(spark, slots, shard_slots, seed=1):
    table = spark.createDataFrame(list(enumerate(slots)), "source_number long, slots long")
    return mixing.shard_draws(table, shard_slots, seed).collect()


def test_draws(spark):
    slots = [1000, 0, 37, 5]
    rows = draws_of(spark, slots, 100)
    assert {(r["shard"], r["source_number"]): (r["first"], r["count"]) for r in rows} == plain_draws(slots, 100, 1)
    assert [sum(r["count"] for r in rows if r["source_number"] == s) for s in range(4)] == slots
    assert len({r["count"] for r in rows if r["source_number"] == 0}) > 2  # drawn, not dealt
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].extend(range(r["place"], r["place"] + r["count"]))
    of = {r["shard"]: r["slots"] for r in rows}
    assert all(sorted(v) == list(range(of[k])) for k, v in places.items())
    assert draws_of(spark, [], 10) == [] and draws_of(spark, [0], 10) == []


def test_draws_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    slots = [1 + i % 7 * (i % 5 == 0) * 100 for i in range(70)]
    rows = draws_of(spark, slots, 300)
    runs = defaultdict(list)
    for r in rows:
        runs[r["source_number"]].append((r["first"], r["first"] + r["count"]))
    for s, own in runs.items():  # a source's slots are all taken, once
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == slots[s] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert len(runs) == len(slots)
    drawn = [r["count"] for r in rows if r["source_number"] == 30 and r["shard"] < sum(slots) // 300 * 2 // 3]
    assert abs(np.mean(drawn) - 300 * slots[30] / sum(slots)) < 4 * np.sqrt(300 * slots[30] / sum(slots) / len(drawn))


def test_many_sources_and_one_row_many_times(spark):
    """50,000 sources of a document each, and one row a third of that many times."""
    rows = spark.range(50_000).select("id", F.hash("id").cast("long"), F.concat(F.lit("s"), F.col("id")), F.lit(3).cast("long"))
    again = spark.range(20_000).select(F.lit(-1).cast("long"), F.lit(5).cast("long"), F.lit("hot"), F.lit(4).cast("long"))
    docs = rows.union(again).toDF("doc_id", "text_hash", "source", "size")
    placed, spans = mixing.mix_spans(docs, block=4)
    assert placed.count() == 70_000 and placed.select("source_number", "offset").distinct().count() == 70_000
    taken = spans.groupBy("source_number", "offset").agg(F.sum("n").alias("n"))
    own = placed.join(taken, ["source_number", "offset"], "left").groupBy("source").agg(F.sum("n").alias("n"), F.max("target").alias("target"), F.max("source_size").alias("size"))
    worst = own.select(F.max(F.abs(F.coalesce("n", F.lit(0)) - F.col("target"))).alias("off"), F.count_if(F.col("n") > 2 * F.col("size")).alias("above")).first()
    assert worst["off"] <= 8 and worst["above"] == 0


def test_mix(spark):
    rows = corpus(9, 80)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"offset": F.lit(1), "target": F.lit("x")}).repartition(4)
    placed, spans = mix(docs, block=4, shard_slots=200)
    assert len(placed) == len(rows)
    size = {(r["source_number"], r["offset"]): r["size"] for r in placed if r["size"]}
    assert sum(size.values()) == sum(len(words(r[1])) for r in rows)
    by = defaultdict(list)
    for (s, at), n in size.items():
        by[s].append((at, n))
    for own in by.values():  # documents fill each source without a gap
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
    taken, places = Counter(), defaultdict(set)
    for s in spans:
        key = (s["source_number"], s["offset"])
        assert 0 <= s["start"] and s["start"] + s["n"] <= size[key] and 1 <= s["n"] <= 4
        assert (s["offset"] + s["start"]) // 4 == s["block"] == (s["offset"] + s["start"] + s["n"] - 1) // 4
        taken[key] += s["n"]
        places[s["shard"]].add(s["place"])
    assert all(v == set(range(len(v))) for v in places.values()) and all(len(v) <= 200 for v in places.values())
    assert all(taken[k] <= 2 * n for k, n in size.items())
    for s, own in by.items():
        total = sum(taken[s, at] for at, _ in own)
        target = next(r["target"] for r in placed if r["source_number"] == s)
        assert abs(total - target) <= 8
    names = {r["source_number"]: r["source"] for r in placed}
    assert list(dict(sorted(names.items())).values()) == sorted({r[3] for r in rows if r[3]}) + [None]
    again = mix(docs.repartition(2), block=4, shard_slots=200)[1]
    assert sorted(again) == sorted(spans)


def test_mixed_documents(spark):
    rows = corpus(9, 40)
    docs = spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1))
    found = mixing.mixed_documents(docs, block=4)
    assert found.columns == docs.columns
    placed, spans = mix(docs, block=4)
    per = Counter()
    where = {(r["source_number"], r["offset"]): r["doc_id"] for r in placed if r["size"]}
    for s in spans:
        per[where[s["source_number"], s["offset"]]] += s["n"]
    got, texts = Counter(), {r[0]: words(r[1]) for r in rows}
    for r in found.collect():
        own = words(r["text"])
        got[r["doc_id"]] += len(own)
        assert r["n_chars"] == len(r["text"])
        whole = iter(texts[r["doc_id"]])
        assert all(w in whole for w in own)  # in order
    assert got == per


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mix(empty) == ([], []) and mixing.mixed_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, " ", "en", None, 1), (2, None, "en", "a", 0)], DOCS)
    placed, spans = mix(blank)
    assert spans == [] and sorted((r["doc_id"], r["size"], r["target"]) for r in placed) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_a_hot_source_keeps_its_share(spark):
    import random

    rng = random.Random(3)
    rows = [(i, prose(rng, 40), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(150)]
    placed, spans = mix(spark.createDataFrame(rows, DOCS), block=8)
    total, want = Counter(), {}
    for s in spans:
        total[s["source_number"]] += s["n"]
    for r in placed:
        want[r["source_number"]] = r["target"]
    assert all(abs(total[s] - t) <= 16 for s, t in want.items())
