import random

import pyarrow as pa
import pytest
from plain import DOCS, corpus, prose, sha, without_repeats
from pyspark.sql import functions as F

from loglantern.llm import passages, queries


@pytest.mark.parametrize("n,seed", [(35, 12), (8, 3), (5, 12), (1, 1)])
def test_against_all_windows(spark, n, seed):
    rng = random.Random(n)
    rows = corpus(3)
    rows += [(900 + i, " ".join(rng.choice("ab") for _ in range(120)), "en", "s", 240) for i in range(3)]  # periods and many ties
    docs = spark.createDataFrame(rows, DOCS).withColumns({"anchor": F.lit(1), "text_hash": F.lit("x"), "runs": F.lit(2)}).repartition(3)
    found = passages.without_repeats(docs, n, seed)
    assert found.columns[: len(docs.columns)] == docs.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["_n_words"], r["_n_removed"], r["_kept_text"]) for r in found.collect())
    want = sorted((r[0] if r[0] is not None else -1, r[1] or "", *w) for r, w in zip(rows, without_repeats([r[1] for r in rows], n), strict=True))
    assert got == want


def test_query(spark, tmp_path):
    rows = [r for r in corpus(4) if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op4_passages"](spark, str(tmp_path)).collect())
    assert got == sorted((r[0], n, g, sha(kept)) for r, (n, g, kept) in zip(rows, without_repeats([r[1] for r in rows], 35), strict=True))


def test_repeated_rows_have_one_set_of_spans(spark, monkeypatch):
    tables, keep = {}, passages.stored

    def seen(df, name):
        tables[name] = keep(df, name)
        return tables[name]

    monkeypatch.setattr(passages, "stored", seen)
    rng = random.Random(6)
    shared = prose(rng, 60)
    rows = 5 * [(1, prose(rng, 40) + " " + shared)] + 4 * [(None, shared + " " + prose(rng, 50))] + [(2, prose(rng, 9) + " " + shared)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = sorted((r["text"], r["_n_words"], r["_n_removed"], r["_kept_text"]) for r in passages.without_repeats(docs).collect())
    assert got == sorted((t, *w) for (_, t), w in zip(rows, without_repeats([t for _, t in rows], 35), strict=True))
    windows = tables["windows"]
    assert windows.count() == windows.distinct().count() > 0

    def counted(words, columns):
        def out(batches):
            for batch in batches:
                runs = batch.column(batch.schema.get_field_index("_runs")).to_pylist()
                assert all(len(r) == len({(s["start"], s["n"]) for s in r}) > 0 for r in runs)
                none = pa.array([0] * len(runs), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:columns], none, none, pa.array([""] * len(runs))], names=[*batch.schema.names[:columns], "_n_words", "_n_removed", "_kept_text"])

        return out

    monkeypatch.setattr(passages, "_without", counted)
    assert len(passages.without_repeats(docs).collect()) == len(rows)


def test_empty_table(spark):
    assert passages.without_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, long, "en", "s", 0), (2, " ".join(long.split()[1000:1100]), "en", "s", 0)]
    got = {r["doc_id"]: r["_n_removed"] for r in passages.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 100, 2: 100}
