import re
from collections import defaultdict

from plain import DOCS, corpus, words
from pyspark.sql import functions as F

from loglantern.llm import host_rules


def measures(text):
    own, text = words(text), text or ""
    places = defaultdict(list)
    for i in range(len(own) - 2):
        places[tuple(own[i : i + 3])].append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdicts(spark):
    rows = corpus(6)
    rows += [(700 + i, "a b c " * 30 + f"#{i} |\nx y\nx y\n\n x y", "en", "bad host", 9) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_salt", F.lit(1)).repartition(3)
    found = host_rules.host_rules(docs).collect()
    assert len(found) == len(rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    assert got == sorted((r[0] if r[0] is not None else -1, *measures(r[1])) for r in rows)
    fails = {}
    for r in rows:
        n, *_, repeated = measures(r[1])
        fails.setdefault(r[3], []).append(n < 50 or 100 * repeated > 50 * n)
    rates = host_rules.host_verdicts(host_rules.measured(docs).withColumnRenamed("source", "host")).collect()
    mean = sum(map(sum, fails.values())) / len(rows)
    for r in rates:
        own = fails[r["host"]]
        low, high = sorted((mean, sum(own) / len(own)))
        assert r["n"] == len(own) and r["failures"] == sum(own) and low - 1e-9 <= r["rate"] <= high + 1e-9
    rejected = {r["host"] for r in rates if r["rejected"]}
    assert "bad host" in rejected
    hosts = {r[0]: r[3] for r in rows}
    for r in found:
        n, repeated = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        if r["doc_id"] is not None:
            assert r["kept"] == (not r["base_failed"] and hosts[r["doc_id"]] not in rejected)


def test_a_small_host_is_not_judged_alone(spark):
    rows = [(h * 100 + i, "a " * 60 if i >= 9 else "x" + " y" * 5 * i, "en", f"h{h}", 0) for h in range(5) for i in range(100 if h else 1)]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text if len(t) > 100 else "short", *rest) for i, t, *rest in rows]
    verdicts = {r["host"]: (r["failures"], r["rejected"]) for r in host_rules.host_verdicts(host_rules.measured(spark.createDataFrame(rows, DOCS)).withColumnRenamed("source", "host")).collect()}
    assert verdicts["h0"] == (1, False)  # its one document fails, but hosts in general are good


def test_empty_table(spark):
    assert host_rules.host_rules(spark.createDataFrame([], DOCS)).collect() == []
