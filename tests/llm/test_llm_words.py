"""Blocks of texts: their hashes, and the memory that a worker takes for them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loglantern.llm import words
from loglantern.llm.near_dups import _signatures
from loglantern.llm.passages import _anchors

TEXT = " ".join(f"w{i * i}" for i in range(280))


def rows(texts):
    n = len(texts)
    return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text_hash": list(range(n)), "text": texts})


def peak(work, batch):
    tracemalloc.start()
    try:
        for _ in work(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker_that_hashes_words():
    batch = rows([f"{i} {TEXT}" for i in range(3000)])  # five million bytes
    for work in (_signatures(5), _anchors(35, 12)):
        assert peak(work, batch) < 60


def test_a_long_text_is_whole_and_leaves_nothing_behind():
    long = "x " + " ".join(f"v{i}" for i in range(500_000)) + " " + TEXT
    data = np.frombuffer(long.encode(), np.uint8)
    own = words.Texts(data, np.array([0, len(data)]))
    short = words.Texts(np.frombuffer(TEXT.encode(), np.uint8), np.array([0, len(TEXT)]))
    assert len(own.start) == 500_001 + 280
    assert (own.hashes()[-280:] == short.hashes()).all()
    assert len(words._powers[0]) <= words.BLOCK_BYTES + 1


def test_stages_of_the_pipeline_take_small_batches(spark):
    import corpus_pipeline as cp

    before = spark.conf.get(cp.ARROW_ROWS)
    try:
        for own, want in (("10000", "1024"), ("0", "1024"), ("100", "100")):
            spark.conf.set(cp.ARROW_ROWS, own)
            assert cp.in_small_batches(lambda s, docs, path: s.conf.get(cp.ARROW_ROWS))(spark, None, "") == want
    finally:
        spark.conf.set(cp.ARROW_ROWS, before)
