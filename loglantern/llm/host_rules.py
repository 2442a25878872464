"""Quality rules over documents, and verdicts on the hosts they come from, in DataFrame functions alone.

Each document is measured once and fails or passes the base rules by itself. Failures are summed by
host; a host's failure rate is shrunk towards the rate of all hosts by a beta prior that is fitted to the
hosts by moments, so that a host of few documents is not judged on those alone. Verdicts
go back to the documents by a join on the host; as a host may hold a third of all rows, its
documents are dealt over `SALTS` parts there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.tables import table
from loglantern.plans.scratch import stored

MIN_WORDS = 50
#: Percent of a text's words that may lie in repeated three-word windows.
MAX_REPEATED = 50
#: A host is rejected when its shrunk failure rate is over this.
MAX_HOST_RATE = 0.5
#: A prior counts as many documents at least and at most.
PRIOR_DOCUMENTS = (2.0, 10_000.0)
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\u000b\f\r "
SALTS = 64


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window whose words occur in a row twice or more.

    Windows are sorted by their words' hash with their places; equal neighbours are the repeats."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeats = bound(pairs, lambda p: F.filter(p, lambda s, i: F.coalesce(F.get(p, i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == s["h"], F.lit(False))))
        return F.size(F.array_distinct(F.flatten(F.transform(repeats, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h))

    return bound(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(bound(windows(w), counted)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures and `base_failed`. A null text has no words; columns of these names are replaced."""
    own = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    measures = bound(
        words_of(own),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    df = docs.withColumns(
        {
            "_words": measures,
            "word_chars": F.length(F.translate(own, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(own) - F.length(F.translate(own, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    df = df.withColumns({"n_words": F.col("_words.n_words"), "n_repeat_words": F.col("_words.n_repeat_words")}).drop("_words")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def host_verdicts(rows: DataFrame, host: str = "host", failed: str = "base_failed") -> DataFrame:
    """host, n, failures, rate (shrunk) and rejected for each host; null is a host of its own.

    The prior has the hosts' mean rate m and, for the variance v of rates that is left when
    the scatter of counting is taken off, m (1 - m) / v - 1 documents, within PRIOR_DOCUMENTS."""
    hosts = stored(rows.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")), "hosts")
    moments = hosts.agg(
        (F.sum("failures") / F.sum("n")).alias("m"),
        F.var_pop(F.col("failures") / F.col("n")).alias("v"),
        F.avg(1 / F.col("n")).alias("noise"),
    ).first()
    m = float(moments["m"] or 0.0)
    between = float(moments["v"] or 0.0) - m * (1 - m) * float(moments["noise"] or 0.0)
    least, most = PRIOR_DOCUMENTS
    strength = min(max(m * (1 - m) / between - 1, least), most) if between > 0 and 0 < m < 1 else most
    shrunk = (F.col("failures") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > MAX_HOST_RATE)


def host_rules(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, the measures, `base_failed`, `host_rate`, `host_rejected` and `kept` for each row of docs.

    kept is false for a document that fails by itself or whose host is rejected. Null keys, texts and hosts are
    kept as rows; other columns are left behind."""
    rows = measured(docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.col(text).alias("text"))).drop("text")
    rows = stored(rows, "measured")
    hosts = host_verdicts(rows, "_host").select(F.col("_host").alias("_name"), F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"))
    hosts = hosts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    # hosts times parts are more than Spark expects of the table of hosts, so they may not be broadcast
    judged = rows.join(hosts.hint("merge"), rows["_host"].eqNullSafe(hosts["_name"]) & (rows["_salt"] == hosts["_part"]))
    return judged.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "host_rate", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; a document's host is its source."""
    return host_rules(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("host_rate")
