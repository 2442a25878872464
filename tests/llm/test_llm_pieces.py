import os
import random

import numpy as np
import pytest
from plain import DOCS, corpus

from loglantern.llm import pieces, queries

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.VOCABULARY), reason="needs the vocabulary files")

ODD = ["", " ", "a  b\n\tc  ", " x", "\U0001f600̀é▁z", "\n\n", "<s> </s> <0x0A>", "中文字符 текст", "a" * 500, "▁▁a", " " * 50 + "x", "def f(x):\n    return  x+1"]


def texts():
    rng = random.Random(1)
    letters = "ab thereinon\n\t ▁éßÑ中\U0001f600.,!?#-_()[]{}0123456789́"
    return ODD + [r[1] for r in corpus(2) if r[1]] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(800)]


def numbers(found):
    return [np.frombuffer(f, np.int32).tolist() for f in found]


def test_pieces_are_those_of_the_library():
    raw = pieces.read_vocabulary()
    own, library = pieces.Vocabulary(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    known = {}
    want = library.encode(texts())
    assert numbers(own.encode(texts(), known)) == want
    assert numbers(own.encode(texts()[::-1], known)) == want[::-1]  # from what is remembered
    for ids, text in zip(want, texts(), strict=True):
        assert own.decode(ids) == text.replace("▁", " ")


def test_unigram_paths_are_best():
    """The same pieces read as a unigram vocabulary: against a search of all paths, word by word."""
    own = pieces.Vocabulary(pieces.read_vocabulary())
    own.kind = pieces.UNIGRAM
    rng = random.Random(2)
    own.scores = [-rng.uniform(1, 20) for _ in own.scores]
    own.worst = min(own.scores) - 10
    words = sorted({w for t in texts()[:40] for w in own.word.findall("▁" + t.replace(" ", "▁")) if len(w) < 30})
    for word, ids in own.forward(words):
        best = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = best[end - 1] + own.worst
            for start in range(end):
                i = own.ids.get(word[start:end])
                if i is not None:
                    best[end] = max(best[end], best[start] + own.scores[i])
        path = np.frombuffer(ids, np.int32).tolist()
        bytes_ = set(own.bytes.values())
        known = sum(own.scores[i] for i in path if i not in bytes_)
        unknown = sum(1 for c in word if c not in own.ids) if any(i in bytes_ for i in path) else 0
        if not any(i in bytes_ for i in path):
            assert known == pytest.approx(best[-1])
        else:
            assert known + unknown * own.worst <= best[-1] + 1e-6


def test_words_are_forgotten_beyond_the_bound(monkeypatch):
    raw = pieces.read_vocabulary()
    own, known = pieces.Vocabulary(raw), {}
    want = numbers(own.encode(texts(), {}))
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "LONGEST_REMEMBERED", 3)
    for t, w in zip(texts()[:80], want):
        assert numbers(own.encode([t], known)) == [w]
    assert all(len(w) <= 3 for w in known)


def test_a_very_long_word_and_text():
    own = pieces.Vocabulary(pieces.read_vocabulary())
    for text in ("ab" * 100_000, "the of and " * 40_000):
        (ids,) = own.encode([text], {})
        assert own.decode(np.frombuffer(ids, np.int32).tolist()) == text


def test_tables_and_round_trip(spark, tmp_path):
    raw = pieces.read_vocabulary()
    rows = corpus(2)
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "_same")
    found = pieces.encoded(docs, raw, check=True)
    back = pieces.decoded(found, raw).collect()
    assert len(back) == len(rows)
    for r in back:
        assert (r["_pieces"] is None) == (r["text"] is None) and r["_decoded"] == r["text"] and r["_same"] in (True, None)
    assert pieces.encoded(spark.createDataFrame([], DOCS), raw).collect() == []
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op6_pieces"](spark, str(tmp_path)).collect()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts_ = {r[0]: r[1] for r in rows}
    assert all((r["pieces"] or []) == library.encode(texts_[r["doc_id"]] or "") and r["n_pieces"] == len(r["pieces"] or []) for r in got)
