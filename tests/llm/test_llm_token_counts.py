import os
from collections import Counter

import pytest
from plain import DOCS, corpus

from loglantern.llm import queries
from loglantern.llm import token_counts as tc

pytestmark = pytest.mark.skipif(not os.path.exists(tc.VOCABULARY), reason="needs the vocabulary files")


def test_against_counting_each_text(spark, tmp_path):
    rows = corpus(3)
    encode = tc._opened(tc.read_ranks(), tc.PATTERN).encode_ordinary
    lengths = [(r[3], len(encode(r[1])) if r[1] else 0) for r in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op2_token_counts"](spark, str(tmp_path)).collect()
    groups = {("all", None): [n for _, n in lengths]}
    for source in {s for s, _ in lengths}:
        groups["source", source] = [n for s, n in lengths if s == source]
    assert len(got) == sum(len(set(v)) for v in groups.values())
    for r in got:
        own, limit = groups[r["scope"], r["group"]], r["n_tokens"]
        assert r["n_docs"] == Counter(own)[limit]
        assert r["docs_within"] == sum(n <= limit for n in own) and r["docs_over"] == sum(n > limit for n in own)
        assert r["tokens_total"] == sum(own) and r["tokens_kept"] == sum(min(n, limit) for n in own)
        assert r["tokens_cut"] == sum(own) - r["tokens_kept"] and r["quantile"] == pytest.approx(sum(n <= limit for n in own) / len(own))


def test_limits_and_quantiles(spark):
    lengths = spark.createDataFrame([("a", n) for n in (0, 3, 3, 10, 50)] + [(None, 7)], "g string, n_tokens long")
    limits = tc.by_limit(tc.length_histogram(lengths, "g"))
    got = {(r["group"], r["limit"]): (r["tokens_kept"], r["docs_over"]) for r in tc.at_limits(limits, [1, 3, 20, 100]).collect()}
    assert got == {("a", 1): (4, 4), ("a", 3): (12, 2), ("a", 20): (36, 1), ("a", 100): (66, 0), (None, 1): (1, 1), (None, 3): (3, 1), (None, 20): (7, 0), (None, 100): (7, 0)}
    quantiles = {(r["group"], r["share"]): r["n_tokens"] for r in tc.length_quantiles(limits, [0.2, 0.5, 1.0]).collect()}
    assert quantiles["a", 0.2] == 0 and quantiles["a", 0.5] == 3 and quantiles["a", 1.0] == 50 and quantiles[None, 0.5] == 7


def test_odd_rows(spark):
    raw = tc.read_ranks()
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 100_000), (4, " "), (None, "x")], "n_tokens long, text string")
    found = tc.token_lengths(docs.withColumnRenamed("n_tokens", "id"), raw)
    got = {r["id"]: r["n_tokens"] for r in found.collect()}
    assert got[1] == got[2] == 0 and got[3] > 1000 and got[4] == 1 and got[None] == 1
    assert tc.by_limit(tc.length_histogram(tc.token_lengths(docs.limit(0), raw))).collect() == []
