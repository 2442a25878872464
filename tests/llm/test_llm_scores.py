"""The two classifiers: held-out accuracy on the given tables, and their parts."""

import os
import re

import numpy as np
import pytest
from plain import DOCS
from pyspark.sql import functions as F

from loglantern.llm import quality_net as qn
from loglantern.llm import queries
from loglantern.llm import toxicity as tx
from loglantern.llm.tables import remainder

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (y == 0).sum())


@given
@pytest.mark.parametrize("name,label,least", [("op1_quality_net", "quality", 0.97), ("op7_toxicity", "toxic", 0.9)])
def test_held_out(spark, name, label, least):
    rows = queries.QUERIES[name](spark, SF)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert rows.count() == docs.count()
    joined = rows.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    score, predicted, y = (np.array([r[c] for r in joined]) for c in ("score", "predicted", label))
    assert ((score >= 0) & (score <= 1)).all() and (predicted == (score >= 0.7)).all()
    assert auc(score, y) > least
    assert (predicted == y).mean() > 0.93


def test_remainder(spark):
    import zlib

    rows = spark.range(50).select("id", remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "Du Idiot! " * 30_000), (6, "é" * 600), (None, "you idiot"), (4, "x")]


def odd(spark):
    rows = [(i, t, "en", "s", 0) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "_score").withColumn("label", F.lit(3))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 0), (5, 1)], "doc_id long, y int")
    net = qn.learned(odd(spark), labels.withColumnRenamed("y", "quality"))
    for scored in (qn.quality(odd(spark), net), qn.quality(odd(spark), None, 0.3)):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r["_score"] <= 1 for r in rows)
        assert len({r["_score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    grammar = tx.learned(odd(spark), labels.withColumnRenamed("y", "toxic"))
    bare = tx.learned(odd(spark), labels.limit(0).withColumnRenamed("y", "toxic"))
    for g in (grammar, bare):
        rows = {(r["doc_id"], r["text"]): r["_score"] for r in tx.toxicity(odd(spark), g).collect()}
        assert len(rows) == len(ODD) - 1 and all(0 <= s <= 1 for s in rows.values())
    assert rows[None, "you idiot"] > 0.7 > rows[4, "x"]
    empty = spark.createDataFrame([], DOCS)
    assert qn.quality(empty, net).collect() == tx.toxicity(empty, bare).collect() == []
    assert qn.learned(empty, labels.withColumnRenamed("y", "quality")) is None


def test_every_byte_counts():
    """A chunk anywhere in a long text changes its score, and the score is that of its chunks apart."""
    net = qn.Net.fresh(1)
    net.bias += 0.1
    net.embedding[255] = 9  # a byte that any filter heeds
    rng = np.random.default_rng(2)
    text = rng.integers(32, 127, 5000).astype(np.uint8)
    score = lambda t: net.scores(t, np.array([0, len(t)]))[0]
    whole = score(text)
    for at in range(0, 4990, 499):
        other = text.copy()
        other[at : at + 10] = 255
        assert score(other) != whole
    chunks = qn.chunk_codes(text)
    filled = np.minimum(1, (chunks != qn._PAD).sum(axis=1) / 512)
    filled = np.clip((len(text) - 256 * np.arange(len(chunks))) / 512, 0, 1)
    best = np.stack([net.cells(c[: 4 * 128 + 5]).max(axis=0) for c in chunks])
    mean = net.head(best, filled)[0].mean()
    assert whole == pytest.approx(1 / (1 + np.exp(-mean)), abs=1e-5)
    block = np.concatenate([text, text[:70]])
    assert net.scores(block, np.array([0, 5000, 5000, 5070]))[[0, 2]] == pytest.approx([whole, score(text[:70])], abs=1e-5)


def test_neighbours_do_not_matter():
    """Every text of a block, empty ones included, scores as it does alone, in any order."""
    net = qn.Net.fresh(1)
    net.bias += 0.1
    rng = np.random.default_rng(8)
    sizes = [0, 1, 2, 5, 0, *range(120, 132), 250, 251, 256, 0, 507, 512, 513, 5000, 0, 60]
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in sizes]
    alone = [net.scores(t, np.array([0, len(t)]))[0] for t in texts]
    for order in (np.arange(len(texts)), np.arange(len(texts))[::-1], rng.permutation(len(texts))):
        block = np.concatenate([texts[i] for i in order])
        bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in order])))
        assert net.scores(block, bounds) == pytest.approx([alone[i] for i in order], abs=1e-6)


@given
def test_reruns_over_other_partitions_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    net = qn.Net.fresh(1)
    net.bias += 0.1
    first, again = ({r["doc_id"]: r["_score"] for r in qn.quality(docs.repartition(n, "text"), net).collect()} for n in (2, 7))
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-6 for k in first)


def test_gradients():
    net = qn.Net.fresh(4)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 257, (6, 4 * 128 + 5)).astype(np.uint16)
    y, w, filled = rng.integers(0, 2, 6).astype(np.float32), np.ones(6, np.float32), np.ones(6)

    def loss():
        best = np.stack([net.cells(c).max(axis=0) for c in codes])
        z = net.head(best, filled)[0].astype(float)
        return np.mean(np.logaddexp(0, z) - y * z)

    slopes = qn._slopes(net, codes, filled, y, w)
    for values, slope in zip(net.weights(), slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept = values[at]
        values[at] = kept + 2e-3
        up = loss()
        values[at] = kept - 2e-3
        down = loss()
        values[at] = kept
        assert (up - down) / 4e-3 == pytest.approx(slope[at], rel=0.1, abs=2e-3)


def clauses(text, grammar=None):
    found = (grammar or tx.Grammar()).open().features(text)
    return {p: v for p, v in zip(tx.PATTERNS, found) if v}


def test_clauses_not_words():
    assert set(clauses("You are an idiot.")) == {"aimed insult"}
    assert set(clauses("Idiot you are")) == {"aimed insult"}
    assert set(clauses("an idiot walked by. You saw it")) == {"insult"}
    assert set(clauses("You are not stupid")) == {"negated"}
    assert set(clauses("It is not so. Stupid thing")) == {"insult"}
    assert set(clauses("He said you are an idiot")) == {"reported"}
    assert set(clauses("Der Mann sagte, dass du ein Trottel bist")) == {"reported"}
    assert set(clauses("I will kill you")) == {"aimed threat"}
    assert set(clauses("the skill of a killer")) == set()
    assert set(clauses("IDIOT! you there")) == {"insult"}
    assert clauses("") == clauses(None) == {}
    own = tx.Grammar({"lowei": 3.0})
    assert clauses("die loweisch du", own) == {"aimed insult": 3.0}
    assert clauses("eloweisch", own) == {}


def test_threats_are_inflected():
    assert set(clauses("he kills you")) == set(clauses("Ich töte dich")) == set(clauses("I will hurt you")) == {"aimed threat"}
    assert set(clauses("they killed her")) == set(clauses("il tuera son voisin")) == {"threat"}
    assert set(clauses("she said they are killing you")) == {"reported"} and set(clauses("nobody would not kill")) == {"negated"}
    assert clauses("skill, killer, material, tu, mate, totem, matter of strangers") == {}
    # a stem that was learned keeps its weight and is a threat; a learned beginning takes any ending
    assert clauses("a killer for you", tx.Grammar({"kill": 3.0})) == {"aimed threat": 3.0}
    assert clauses("we smashed you", tx.Grammar({}, {"smash": 2.5})) == {"aimed threat": 2.5}


def plain_features(grammar, text):
    """The same by looking around each word, without transducers."""
    out = dict.fromkeys(tx.PATTERNS, 0.0)
    text = (text or "").lower()
    for clause in re.split(r"[.!?;:\n]+", text):
        words = re.findall(r"[^\W\d_]+", clause)
        kinds = []
        for w in words:
            options = [(len(s), tx.THREAT, 2.0) for s, ends in tx.ENDINGS.items() if w.startswith(s) and w[len(s) :] in ends]
            options += [(len(s), tx.INSULT, 2.0) for s in tx.INSULTS if w.startswith(s)]
            options += [(len(s), k, v) for k, own in ((tx.INSULT, grammar.insults), (tx.THREAT, grammar.threats)) for s, v in own.items() if w.startswith(s)]
            kinds.append(max(options)[1:] if options else None)
        near = lambda i, own, reach: any(w in own and not kinds[j] for j, w in enumerate(words) if 0 < i - j <= reach)
        for i, kind in enumerate(kinds):
            if not kind:
                continue
            behind = any(w in tx.TARGETS and not kinds[j] for j, w in enumerate(words) if 0 < j - i <= tx.TARGET_REACH)
            if near(i, tx.REPORTS, len(words)):
                name = "reported"
            elif near(i, tx.NEGATIONS, tx.NEGATION_REACH):
                name = "negated"
            else:
                name = "aimed " * (behind or near(i, tx.TARGETS, tx.TARGET_REACH)) + ("threat" if kind[0] == tx.THREAT else "insult")
            out[name] += kind[1]
    return out


def test_grammar_against_a_plain_version():
    rng = np.random.default_rng(11)
    grammar = tx.Grammar({"lowei": 3.0, "smu": 1.5}, {"gra": 2.5}).open()
    pool = [*tx.INSULTS, *tx.TARGETS, *tx.NEGATIONS, *tx.REPORTS, *"kills killing killer töte tötet tuera matar mate loweisch smut grabbed the of a ein walks".split()]
    for _ in range(400):
        parts = [str(rng.choice(pool)) + str(rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n", ": "])) for _ in range(rng.integers(0, 40))]
        text = "".join(parts)
        found = dict(zip(tx.PATTERNS, grammar.features(text), strict=False))
        assert found == pytest.approx(plain_features(grammar, text)), text


def test_threats_are_learned(spark):
    """Words with a target behind them are learned as threats, others as insults; an id that is there 10,000 times is one row."""
    rng = np.random.default_rng(3)
    other = lambda n: " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n))
    rows = [(i, f"{other(6)} smorfle you {other(5)}. {other(4)} smorfled dich. {other(3)} the gribnak {other(8)} gribnak" if i % 2 else other(30), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[1][:2]] * 10_000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    grammar = tx.learned(docs, labels)
    assert any(w.startswith("smo") for w in grammar.threats) and not any(w.startswith("gri") for w in grammar.threats)
    assert all(w.startswith(("gri", "smo")) for w in (*grammar.threats, *grammar.insults))
    assert clauses("they will smorfle you", grammar).keys() == {"aimed threat"}


def test_composition_is_one_machine_after_the_other():
    f, g = tx.marker(tx.NEGATION, 2, "negated"), tx.marker(tx.REPORT, None, "reported")
    both = tx.composed(f, g)
    rng = np.random.default_rng(5)
    for _ in range(200):
        symbols = [(int(c), frozenset()) for c in rng.integers(0, 6, 12)]
        assert both.run(symbols) == g.run(f.run(symbols))
