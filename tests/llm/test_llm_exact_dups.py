"""Exact duplicates against a plain grouping, and the perfect hash by itself."""

import hashlib
import random
import re

import numpy as np
import pytest
from plain import DOCS, corpus
from pyspark.sql import functions as F

from loglantern.llm import exact_dups as ed
from loglantern.llm.tables import remainder


def raw(n, seed=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}/{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 64, 1000, 8192])
def test_slots_are_minimal_and_perfect(n):
    own = raw(n)
    numbers, slots = ed.perfect_hash(own)
    assert sorted(slots) == list(range(n))
    assert (ed.slots_of(own, numbers, n) == slots).all()
    strangers = ed.slots_of(raw(50, 1), numbers, n)
    assert ((strangers >= 0) & (strangers < n)).all()


def plain(rows):
    """(doc_id, text) -> per row its digest, the row that stays and the group's size."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for i, key in enumerate(norm):
        groups.setdefault(key, []).append(i)
    out = []
    for (doc_id, _), key in zip(rows, norm, strict=True):
        best = min(groups[key], key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out.append((doc_id, rows[best][0], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def odd_rows():
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in corpus()]
    rows += [(1000 + i, t) for i, t in enumerate(["a b", "ab", "a b", "é" * 70_000 + " ", "é" * 70_000, "\t", "A b"])]
    rows += [(2000 + i, " ".join("hot copy")[: rng.choice([14, 15])]) for i in range(300)]
    rows += [(7, "same row")] * 40 + [(None, "same row"), (None, "nobody"), (None, "nobody")]
    return rows


@pytest.mark.parametrize("shard_digests,part_rows", [(ed.SHARD_DIGESTS, ed.PART_ROWS), (5, 16)])
@pytest.mark.parametrize("known", ["half", "none", "all"])
def test_against_plain(spark, shard_digests, part_rows, known):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit("x"), "digest": F.lit(1), "slot": F.lit(2)})
    rule = {"half": remainder(F.col("doc_id"), 2) == 0, "none": F.lit(None).cast("boolean"), "all": F.lit(True)}[known]
    got = ed.exact_duplicates(docs.repartition(3), rule, shard_digests, part_rows).collect()
    want, groups = plain(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and len({bytes(r["digest"]) for r in kept}) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    members = [r for r in got if r["slot"] is not None]
    assert bool(members) == (known != "none") and (len(members) == len(got)) == (known == "all")


def test_what_stays(spark):
    rows = [(r[0], r[1], "en", "s", 0) for r in odd_rows()]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "_digest")
    stay = ed.without_exact_duplicates(docs, remainder(F.col("doc_id"), 2) == 0)
    assert stay.columns == [c for c in docs.columns if c != "_digest"]
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in stay.collect()]
    assert len(texts) == len(set(texts)) == plain([r[:2] for r in rows])[1]


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert ed.exact_duplicates(docs, F.lit(True)).collect() == []
    assert ed.without_exact_duplicates(docs, F.lit(True)).collect() == []
