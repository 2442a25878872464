"""Token counts of a corpus from its exact histogram of lengths.

Documents are encoded and counted once; rows of (group, length) are summed to a histogram, before they are shuffled.
Sums over its lengths then answer, for every context limit that could matter: how many documents fit, how many
tokens there are, how many are left when longer documents are cut off, and which share of documents is no longer.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglantern.llm.tables import table
from loglantern.plans.scratch import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published pattern by which this vocabulary's texts are split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = VOCABULARY) -> bytes:
    """A file of ranks, read on the driver; tasks get its bytes, so they need not see the path."""
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def _opened(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _lengths(raw: bytes, pattern: str, columns: int, at: int):
    def rows(batches):
        encode = _opened(raw, pattern).encode_ordinary
        for batch in batches:
            found = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(found, pa.int64())], names=[*batch.schema.names[:columns], "n_tokens"])

    return rows


def token_lengths(docs: DataFrame, raw: bytes, pattern: str = PATTERN) -> DataFrame:
    """docs with `n_tokens` instead of its text; null and empty texts have none."""
    docs = docs.drop("n_tokens")
    names = [c for c in docs.columns if c != "text"]
    ordered = docs.select(*names, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*names).schema), "n_tokens long"])
    return ordered.mapInArrow(_lengths(raw, pattern, len(names), len(names)), schema)


def length_histogram(lengths: DataFrame, group: str | None = None) -> DataFrame:
    """group (string; null groups are one), n_tokens, n_docs: the documents of each length, over all and by group."""
    own = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return lengths.groupBy(own.alias("group"), "n_tokens").agg(F.count("*").alias("n_docs"))


def by_limit(histogram: DataFrame) -> DataFrame:
    """What each context limit leaves, for all lengths that occur as limits.

    Adds to each row of the histogram: docs_within and docs_over (documents of up to, and of more than, n_tokens), tokens_total (of the
    group), tokens_kept (when longer documents are cut off at the limit), tokens_cut, and quantile (the share within).
    A limit between two lengths has the figures of the lower one, but for n_tokens more of each document over it (`at_limits`).
    A group's rows are as many as it has lengths."""
    up = Window.partitionBy("group").orderBy("n_tokens")
    all_ = Window.partitionBy("group")
    df = histogram.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    df = df.withColumns({"docs_within": F.sum("n_docs").over(up), "_within": F.sum("_tokens").over(up), "_docs": F.sum("n_docs").over(all_), "tokens_total": F.sum("_tokens").over(all_)})
    df = df.withColumn("docs_over", F.col("_docs") - F.col("docs_within"))
    df = df.withColumn("tokens_kept", F.col("_within") + F.col("n_tokens") * F.col("docs_over"))
    df = df.withColumn("tokens_cut", F.col("tokens_total") - F.col("tokens_kept")).withColumn("quantile", F.col("docs_within") / F.col("_docs"))
    return df.drop("_tokens", "_within", "_docs")


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """group, limit, tokens_kept, docs_over for chosen limits, from the rows of `by_limit`."""
    marks = F.explode(F.array(*[F.lit(int(w)) for w in wanted])).alias("limit")
    below = limits.select("*", marks).filter("n_tokens <= limit").groupBy("group", "limit").agg(F.max(F.struct("n_tokens", "tokens_kept", "docs_over", "docs_within")).alias("r"))
    none = limits.groupBy("group").agg(F.sum("n_docs").alias("docs"), F.min("n_tokens").alias("least")).select("*", marks).filter("least > limit")
    some = below.select("group", "limit", (F.col("r.tokens_kept") + (F.col("limit") - F.col("r.n_tokens")) * F.col("r.docs_over")).alias("tokens_kept"), F.col("r.docs_over").alias("docs_over"))
    return some.unionByName(none.select("group", "limit", (F.col("limit") * F.col("docs")).alias("tokens_kept"), F.col("docs").alias("docs_over")))


def length_quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """group, share, n_tokens: the least length that so large a share of the group's documents does not exceed."""
    marks = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return limits.select("*", marks).filter("quantile >= share").groupBy("group", "share").agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_counts(spark, sf_dir) -> DataFrame:
    """For every length that occurs, over all documents and by source, what a context limit of that length leaves."""
    lengths = token_lengths(table(spark, sf_dir, "documents", "source", "text"), read_ranks())
    sources = stored(length_histogram(lengths, "source"), "histogram")
    every = sources.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).select(F.lit(None).cast("string").alias("group"), "n_tokens", "n_docs")
    columns = lambda scope, df: df.select(F.lit(scope).alias("scope"), *df.columns)
    return columns("source", by_limit(sources)).unionByName(columns("all", by_limit(every)))
