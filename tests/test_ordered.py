import random

from pyspark.sql import functions as F

from loglantern.operators.context import expand, range_coalesce
from loglantern.plans.ordered import first_reaching, neighbours, number_rows, scan


def rows_of(seed, hosts=4, most=60):
    rng = random.Random(seed)
    return [(f"h{h}", rng.randint(0, 40), i) for h in range(hosts) for i in range(rng.randint(1, most) * (10 if h == 0 else 1))]


def test_number_rows(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "host string, at bigint, tie bigint").repartition(7)
    got = {(r["host"], r["at"], r["tie"]): r["seq"] for r in number_rows(df, ["host"], ["at", "tie"]).collect()}
    want = {}
    for host in {r[0] for r in rows}:
        for n, r in enumerate(sorted(x for x in rows if x[0] == host), 1):
            want[r] = n
    assert got == want


def test_scans_and_neighbours(spark):
    rng = random.Random(2)
    rows = [(f"h{h}", s, rng.choice([None, rng.randint(-9, 9)])) for h in range(5) for s in sorted(rng.sample(range(1, 90), 30))]
    df = spark.createDataFrame(rows, "host string, seq bigint, v bigint")
    by_host = {h: [r for r in rows if r[0] == h] for h in {r[0] for r in rows}}
    for how in ("last", "sum", "min", "max"):
        for backwards in (False, True):
            for inclusive in (True, False):
                got = {(r["host"], r["seq"]): r["out"] for r in scan(
                    df, ["host"], F.col("v"), "out", how=how, size=7, backwards=backwards, inclusive=inclusive).collect()}
                for host, part in by_host.items():
                    seen = []
                    for _, seq, v in reversed(part) if backwards else part:
                        values = [x for x in (seen + [v] if inclusive else seen) if x is not None]
                        if how == "sum":
                            want = sum(values)
                        else:
                            want = {"last": lambda x: x[-1], "min": min, "max": max}[how](values) if values else None
                        assert got[(host, seq)] == want, (how, backwards, inclusive)
                        seen.append(v)
    got = {(r["host"], r["seq"]): (r["before"], r["after"]) for r in neighbours(df, ["host"], F.col("seq"), size=7).collect()}
    for host, part in by_host.items():
        seqs = [None, *[r[1] for r in part], None]
        for i in range(1, len(seqs) - 1):
            assert got[(host, seqs[i])] == (seqs[i - 1], seqs[i + 1])


def test_first_reaching(spark):
    rng = random.Random(3)
    points = []
    for host in ("a", "b"):
        v = w = 0
        for seq in sorted(rng.sample(range(1, 400), 120)):
            v, w = v + rng.choice([0, 0, 1, 7]), w + rng.choice([1, 50])
            points.append((host, seq, v, w))
    probes = [(h, rng.choice([None, *range(-5, 400, 7)]), rng.randint(-5, 4000), i) for h in ("a", "b", "c") for i in range(60)]
    left = spark.createDataFrame(points, "host string, seq bigint, v bigint, w bigint")
    right = spark.createDataFrame(probes, "host string, v bigint, w bigint, probe bigint")
    for size, fan in ((7, 3), (65536, 512)):
        got = {(r["host"], r["probe"]): (r["v"], r["w"]) for r in first_reaching(left, right, ["host"], ["v", "w"], size=size, fan=fan).collect()}
        assert all(found != (None, None) for found in got.values())
        for host, v, w, i in probes:
            first = lambda at, want: next((p[1] for p in points if p[0] == host and want is not None and p[at] >= want), None)
            want = (first(2, v), first(3, w))
            assert got.get((host, i), (None, None)) == want


def test_ranges(spark):
    rng = random.Random(4)
    rows = [(h, low, low + rng.randint(0, 6)) for h in ("a", "b") for low in (rng.randint(0, 120) for _ in range(30))]
    df = spark.createDataFrame(rows, "host string, low bigint, high bigint")
    got = sorted((r["host"], r["low"], r["high"]) for r in range_coalesce(df, size=5).collect())
    want = []
    for host in ("a", "b"):
        held = sorted({x for h, low, high in rows if h == host for x in range(low, high + 1)})
        for x in held:
            if want and want[-1][0] == host and want[-1][2] == x - 1:
                want[-1] = (host, want[-1][1], x)
            else:
                want.append((host, x, x))
    assert got == want
    numbers = [r["seq"] for r in expand(df.where("host = 'a'"), "low", "high", 5).collect()]
    assert sorted(numbers) == sorted(x for h, low, high in rows if h == "a" for x in range(low, high + 1))
