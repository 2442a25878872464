"""Hard negatives against a plain search, with ties, repeated rows and odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, step, low=30, high=90, n_positive=5, n_negative=10):
    fit = [
        (i, [math.floor(256 * float(x)) for x in v], y)
        for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, v, y) in enumerate(fit):
        if i is None or i % step:
            continue
        score = [(-sum(p * q for p, q in zip(v, w, strict=True)), j is None, j or 0, k) if len(v) == len(w) else None for k, (j, w, _) in enumerate(fit)]
        order = sorted(s for s in score if s is not None)
        best = [s for s in order if s[3] != a and fit[s[3]][2] == y][:n_positive]
        for p in best:
            inside = [s for s in order if fit[s[3]][2] != y and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:n_negative]
            out += [(i, fit[p[3]][0], r, fit[s[3]][0], -p[0], -s[0]) for r, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def rows(seed, n, dim=6, labels=3, coarse=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.5]) if coarse else rng.gauss(0.2, 0.4) for _ in range(dim)]
        out.append((i, [float(np.float32(x)) for x in v], rng.randrange(labels)))
    return out


def odd():
    nan, inf = float("nan"), float("inf")
    many = rows(3, 120, coarse=True)
    hot = many[5][1]
    many += [(1000 + i, hot, 1) for i in range(90)] + [(2000, many[0][1], None), (2001, None, 1), (2002, [nan] * 6, 1), (2003, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1)]
    many += [(2004, [inf] + [0.0] * 5, 2), (2010, [0.5] * 4, 1), (2020, [0.25] * 4, 1), (2021, [0.25] * 4, 0), (2022, [], 1), (2030, [], 1), (2031, [], 0)]
    many += [(None, many[7][1], 2), (None, many[8][1], 0), (2040, [0.0] * 6, 1), (2050, [-0.5] * 6, 0), (2060, [-0.25] * 6, 0), (10, many[10][1], many[10][2])]
    return many


def mined(spark, data, step, **blocks):
    df = spark.createDataFrame(data, SCHEMA).withColumns({"place": F.lit("x"), "id": F.lit(1), "v": F.lit(2)})
    found = hn.hard_negatives(hn.whole_vectors(df.repartition(3)), F.col("id") % step == 0, **blocks).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("blocks", [{}, {"row_block": 17, "anchor_block": 4}])
def test_against_plain(spark, blocks):
    for data, step in ((rows(1, 200), 10), (odd(), 10)):
        want = plain(data, step)
        assert want and mined(spark, data, step, **blocks) == want


def test_limits_and_counts(spark):
    data = rows(9, 150)
    for low, high, n_positive, n_negative in ((30, 90, 1, 3), (0, 100, 7, 40), (60, 61, 5, 10)):
        df = hn.whole_vectors(spark.createDataFrame(data, SCHEMA))
        found = hn.hard_negatives(df, F.col("id") % 15 == 0, n_positive, n_negative, low, high).collect()
        assert sorted((tuple(r) for r in found), key=str) == plain(data, 15, low, high, n_positive, n_negative)


def test_nothing_to_mine(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, [1.0], 1)], 10) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 10) == []
    assert mined(spark, [(1, [1.0], 1), (2, [0.5], 2)], 10) == []


def test_large_components_stay_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**12, 1.0], [2.0**30, 0.0], [-(2.0**30), 0.0]])
    assert hn.products(a, b).tolist() == [[2**52 + 3, 2**54, -(2**54)]]
