import random

import numpy as np
import pyarrow as pa
import pytest
from plain import DOCS, components, corpus, near_links, prose, shingle_set
from pyspark.sql import functions as F

from loglantern.llm import near_dups
from loglantern.llm.words import mixed


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, k):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"text_hash": F.lit("x"), "band": F.lit(1)}).repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(docs, k).collect())
    sets = {i: shingle_set(r[1], k) for i, r in enumerate(rows)}
    found = components(sets, near_links(sets, 80))
    least = {}
    for i, c in found.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[i][0])
    want = []
    for i, r in enumerate(rows):
        own = least[found[i]] if sets[i] else r[0]
        want.append((r[0] if r[0] is not None else -1, len(sets[i]), own, r[0] == own))
    assert got == sorted(want)
    assert any(not x[3] for x in got)


def test_one_band_of_many_unlike_texts_is_compared_by_blocks(spark, monkeypatch):
    # every set in one band, in blocks of a few sets
    def one_band(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, 7)), batch.column(0)], names=["band", "class"])

    monkeypatch.setattr(near_dups, "_bands", one_band)
    monkeypatch.setattr(near_dups, "BLOCK_CLASSES", 5)
    rows = corpus(8, 40)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs.where("doc_id IS NOT NULL"), 2).collect()}
    sets = {r[0]: shingle_set(r[1], 2) for r in rows if r[0] is not None}
    found = components(sets, near_links(sets, 80))
    assert got == {i: found[i] for i in sets}
    assert len(set(found.values())) < len(found) - 3


def test_repeated_rows_are_one_member(spark, monkeypatch):
    tables, keep = {}, near_dups.stored

    def seen(df, name):
        tables[name] = keep(df, name)
        return tables[name]

    monkeypatch.setattr(near_dups, "stored", seen)
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(3)]
    rows = 5 * [(1, texts[0]), (None, texts[1])] + 3 * [(2, texts[0] + " end"), (None, texts[1] + " end")] + [(3, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dups.near_duplicates(docs, 2).collect())
    assert got == sorted(8 * [(0, 0, True)] + 5 * [(1, 1, True)] + 3 * [(2, 1, False)] + [(3, 3, True)])
    names = [r["class"] for r in tables["members"].collect()]
    assert len(names) == len(set(names)) == 4


def test_empty_table(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_estimates_are_near_and_chance_is_taken_off():
    rng = np.random.default_rng(1)
    for n, share in ((400, 0.8), (3000, 0.5), (60, 0.9)):
        guesses = []
        for _ in range(60):
            common, a, b = (mixed(rng.integers(0, 2**62, m).astype(np.uint64)) for m in (int(n * share), int(n * (1 - share) / 2), int(n * (1 - share) / 2)))
            sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
            regs = near_dups.registers(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            size = np.array([[len(sets[0])], [len(sets[1])]])
            guesses.append(near_dups.estimates(regs[:1], regs[1:], size[0], size[1])[0][0])
            if _ == 0:
                full = near_dups.filled(regs)
                assert (full != 0).all() and (full[regs != 0] == regs[regs != 0]).all()
        assert abs(np.mean(guesses) - share) < 0.03
    # sets with nothing in common agree in a register about as often as expected
    sets = [np.unique(mixed(rng.integers(0, 2**62, 5000).astype(np.uint64))) for _ in range(400)]
    regs = near_dups.registers(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
    same = np.mean([(regs[i] == regs[j]).mean() for i in range(0, 400, 2) for j in range(1, 400, 8)])
    assert same == pytest.approx(near_dups.chance_matches(np.array([5000.0]), np.array([5000.0]))[0], rel=0.25)
