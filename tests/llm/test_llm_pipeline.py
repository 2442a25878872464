import random

import corpus_pipeline
from plain import DOCS, components, near_links, prose, shingle_set, targets, without_repeats, words

from loglantern.llm.mixing import WEIGHTS


def docs_rows():
    rng = random.Random(7)
    rows = []
    for i in range(90):
        text = prose(rng, rng.choice([30, 60, 120]))
        if i % 5 == 0:
            text = ". ".join(f"{t} you idiot and stupid moron" for t in text.split(".")) + " you idiot"
        rows.append([i, text, "en", f"s{i % 4 if i % 3 else 0}", 0])
    shared = prose(rng, 60)
    for i in (11, 22, 33):
        rows[i][1] += " " + shared
    for i in (41, 61, 62):
        rows[i][1] = rows[13][1] + " " + "end " * (i % 3)
    rows += [[200, None, "en", None, 0], [201, "", "en", "s1", 0], [202, "x y", "en", None, 3], [203, rows[13][1], "fr", "s2", 5]]
    return [tuple(r) for r in rows]


def test_stages(spark, tmp_path):
    rows = docs_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0 and i < 90)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, (toxic, near, passages, mixing, pieces) = str(tmp_path), [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def put(df, name):
        assert name == "e" or df.columns == docs.columns
        df.write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    def ids(df):
        return sorted(r["doc_id"] for r in df.collect())

    clean = put(toxic(spark, docs, sf), "a")
    assert ids(clean) == [i for i, *_ in rows if i % 5 or i >= 90]

    kept = put(near(spark, clean, sf), "b")
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in clean.collect()}
    found = components(sets, near_links(sets, 80))
    assert ids(kept) == sorted(i for i, c in found.items() if i == c) and len(ids(kept)) < len(ids(clean))

    parted = put(passages(spark, kept, sf), "c")
    before = sorted(kept.collect(), key=lambda r: r["doc_id"])
    after = {r["doc_id"]: r["text"] for r in parted.collect()}
    plain = without_repeats([r["text"] for r in before], 35)
    assert sum(gone > 0 for _, gone, _ in plain) >= 3
    for r, (_, gone, text) in zip(before, plain, strict=True):
        assert after[r["doc_id"]] == (text if gone else r["text"])

    mixed = put(mixing(spark, parted, sf), "d")
    size, taken = {}, {}
    source = {r["doc_id"]: r["source"] for r in parted.collect()}
    for i, text in after.items():
        size[source[i]] = size.get(source[i], 0) + len(words(text))
    for r in mixed.collect():
        own = words(r["text"])
        assert own and r["n_chars"] == len(r["text"])
        rest = iter(words(after[r["doc_id"]]))
        assert all(w in rest for w in own)
        taken[r["source"]] = taken.get(r["source"], 0) + len(own)
    names = sorted((s for s in size if s), key=str) + [None]
    want = targets([size[s] for s in names], [WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))
    assert all(abs(taken.get(s, 0) - t) <= 64 for s, t in zip(names, want, strict=True))

    last = put(pieces(spark, mixed, sf), "e").collect()
    assert len(last) == mixed.count() and all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) > 0 for r in last)
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_pieces"]) for r in run) == sorted((r["doc_id"], r["n_pieces"]) for r in last)


def test_null_and_tied_ids_make_no_group(spark):
    rng = random.Random(8)
    unlike = [prose(rng, 40) for _ in range(6)]
    near = unlike[0] + " end"
    rows = [(None, t) for t in unlike[:3]] + [(None, near), (None, unlike[1]), (7, unlike[3]), (7, unlike[4]), (8, unlike[5]), (None, unlike[5] + " end"), (7, unlike[3])]
    rows += [(None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect())
    first = [t for _, t in kept if t in (unlike[0], near)]
    assert len(first) == 1
    assert kept == sorted([(0, first[0]), (0, unlike[1]), (0, unlike[2]), (7, unlike[3]), (7, unlike[4]), (8, unlike[5]), (0, ""), (0, "")])
