"""Toxicity by a weighted pattern grammar of finite-state transducers.

The first transducer reads letters: a trie of word beginnings and whole words writes one symbol for each
word of a clause (insult, threat, target, negation, report or other). The next ones read those symbols:
one runs from the right and marks insults and threats that a target follows, one marks those that a target
comes before, one those under a negation, one those in reported speech. These four are composed into two
machines, one for each direction, and run over the clauses in which the trie has found an insult or
a threat. What a clause matches (plain, aimed, negated or reported, by insult or threat) is scored, not its words alone:
a document's score is a logistic function of the weights that its clauses gather by pattern and of their
density. Threats of the base list are stems with the endings of their language. Words beyond the base lists, their
class (a threat is what mostly has a target behind it, an insult anything else), their weights and the function's
coefficients are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.tables import remainder, table
from loglantern.plans.scratch import stored

#: Labelled documents that are learned from, at most.
LEARN_DOCUMENTS = 20_000
#: Word beginnings that are weighed against each other, at most.
CANDIDATES = 2000
THRESHOLD = 0.7

# Base words, in English, German, French and Spanish.
INSULTS = """idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool imbecile
dumm dummkopf trottel abschaum arschloch widerlich erbärmlich imbécile crétin connard ordure minable
idiota estúpido imbécil basura escoria asqueroso""".split()
# Stems of threats, and what may follow them: English, German, French, Spanish.
THREATS = [
    ("kill murder hurt strangl stab shoot", "- s e es ed ing bed bing"),
    ("töt erwürg umbring erschieß erstech", "e st t est et en te test ten ete etest eten end"),
    ("tu assassin étrangl", "er e es ent ez ons é ée és ées ant erai eras era erons erez eront"),
    ("mat asesin estrangul", "ar o as a an amos aré arás ará aremos arán é aste ó aron ando ado ada"),
]
ENDINGS = {stem: frozenset(e.replace("-", "") for e in ends.split()) for stems, ends in THREATS for stem in stems.split()}
TARGETS = """you your yours yourself du dich dir dein euch euer tu toi te ton vous votre tú ti usted ustedes vosotros""".split()
NEGATIONS = """not no never neither nor nicht kein keine nie niemals pas jamais aucun non nunca jamás ningún""".split()
REPORTS = """said says wrote called quoted claimed sagte sagt schrieb nannte zitierte dit écrit appelait citait dijo dice escribió llamó""".split()

BOUNDARY = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: How many words on a negation or a target still speaks.
NEGATION_REACH, TARGET_REACH = 2, 3
SHORTEST, LONGEST = 3, 8

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)


@dataclass(frozen=True)
class Machine:
    """A sequential transducer: (state, symbol) to (state, symbol), from state 0. Symbols are (class, marks)."""

    step: dict

    def run(self, symbols):
        state, out = 0, []
        for s in symbols:
            state, o = self.step[state, s]
            out.append(o)
        return out


def _all_symbols():
    return [(c, frozenset(m)) for c in range(6) for m in _subsets(("after", "before", "negated", "reported")) if c in (INSULT, THREAT) or not m]


def _subsets(marks):
    return [[m for i, m in enumerate(marks) if n >> i & 1] for n in range(1 << len(marks))]


def marker(opens: int, reach: int | None, mark: str) -> Machine:
    """Marks insults and threats up to `reach` words on from a word of the class `opens`; None: to the clause's end."""
    step, last = {}, reach or 1
    for state in range(last + 1):
        for c, marks in _all_symbols():
            hit = c in (INSULT, THREAT) and state
            to = last if c == opens else state if reach is None else max(0, state - 1)
            step[state, (c, marks)] = (to, (c, marks | {mark}) if hit else (c, marks))
    return Machine(step)


def composed(f: Machine, g: Machine) -> Machine:
    """The machine that writes what g writes on reading what f writes."""
    names, todo, step = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        p, q = todo.pop()
        for s in _all_symbols():
            p2, middle = f.step[p, s]
            q2, out = g.step[q, middle]
            if (p2, q2) not in names:
                names[p2, q2] = len(names)
                todo.append((p2, q2))
            step[names[p, q], s] = (names[p2, q2], out)
    return Machine(step)


def _letters(low: str, at: int) -> str:
    """The letters from a place on."""
    rest = WORD.match(low, at)
    return rest.group() if rest else ""


def clauses_of(low: str, found: dict):
    """The clauses that hold a hit, as (place, word) in order."""
    cuts = [m.start() for m in BOUNDARY.finditer(low)]
    for number in sorted({bisect_right(cuts, start) for start in found}):
        begin = cuts[number - 1] if number else 0
        end = cuts[number] if number < len(cuts) else len(low)
        yield [(m.start(), m.group()) for m in WORD.finditer(low, begin, end)]


#: What clauses match. A word under a negation or a report counts as that, whatever else it is.
PATTERNS = ("insult", "aimed insult", "threat", "aimed threat", "negated", "reported")


def pattern_of(symbol) -> int | None:
    c, marks = symbol
    if c not in (INSULT, THREAT):
        return None
    if "reported" in marks:
        return 5
    if "negated" in marks:
        return 4
    return 2 * (c == THREAT) + bool(marks)


@dataclass
class Grammar:
    """Weights of word beginnings, and the coefficients of the score."""

    insults: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    coefficients: np.ndarray | None = None

    def open(self):
        import ahocorasick

        trie = ahocorasick.Automaton()
        for word in INSULTS:
            trie.add_word(word, (word, INSULT, 2.0, None))
        for kind, words in ((INSULT, self.insults), (THREAT, self.threats)):
            for word, weight in words.items():
                trie.add_word(word, (word, kind, weight, None))
        for stem, ends in ENDINGS.items():
            # a stem that was learned keeps its weight, and may end in any way
            weight = self.threats.get(stem, self.insults.get(stem))
            trie.add_word(stem, (stem, THREAT, 2.0, ends) if weight is None else (stem, THREAT, weight, None))
        trie.make_automaton()
        self.trie = trie
        self.classes = {w: c for words, c in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET)) for w in words}
        self.backward = marker(TARGET, TARGET_REACH, "after")
        self.forward = composed(composed(marker(TARGET, TARGET_REACH, "before"), marker(NEGATION, NEGATION_REACH, "negated")), marker(REPORT, None, "reported"))
        return self

    def hits(self, low: str) -> dict[int, tuple]:
        """By where a word starts: the class and weight of the longest entry that begins it."""
        found: dict[int, tuple] = {}
        for end, (word, kind, weight, ends) in self.trie.iter(low):
            start = end - len(word) + 1
            if (start and low[start - 1].isalpha()) or (ends is not None and _letters(low, end + 1) not in ends):
                continue
            if start not in found or found[start][2] < end:
                found[start] = (kind, weight, end)
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Weights by pattern, hits, and the text's length in words (six letters each)."""
        out = np.zeros(len(PATTERNS) + 2)
        low = (text or "").lower()
        out[-1] = len(low) / 6
        found = self.hits(low) if low else {}
        if not found:
            return out
        out[-2] = len(found)
        for words in clauses_of(low, found):
            symbols = [((found[at][0] if at in found else self.classes.get(w, OTHER)), frozenset()) for at, w in words]
            symbols = self.forward.run(self.backward.run(symbols[::-1])[::-1])
            for (at, _), symbol in zip(words, symbols, strict=True):
                if (p := pattern_of(symbol)) is not None:
                    out[p] += found[at][1]
        return out


def inputs(features: np.ndarray) -> np.ndarray:
    """The columns of the logistic function."""
    weights, hits, size = features[:, :-2], features[:, -2], features[:, -1]
    total = weights.sum(axis=1)
    density = np.log1p(100 * total / (size + 20))
    return np.column_stack([np.ones(len(size)), np.log1p(weights), density, np.minimum(hits, 3), np.log1p(size) / 5])


def probabilities(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton's method, drawn to 0 but for the first."""
    b, pull = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    pull[0, 0] = 1e-6
    for _ in range(rounds):
        p = probabilities(x, b)
        slope = x.T @ (y - p) - pull @ b
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, slope)
        b = b + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return b


def _beginnings(text: str | None) -> Counter:
    """How often each beginning of three to eight letters of a word, and each word, occurs."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for k in range(SHORTEST, min(len(word), LONGEST) + 1):
            out[word[:k]] += n
    return out


def _counted(batches):
    """Documents with each beginning, by label, for one partition."""
    by = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by[y].update(_beginnings(text).keys())
    words = list(by[0].keys() | by[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array([by[1][w] for w in words], pa.int64()), pa.array([by[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"]
    )


def _matches(candidates: list[str]):
    place = {w: i for i, w in enumerate(candidates)}

    def rows(batches):
        for batch in batches:
            doc, word, hits, label, size = [], [], [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(place[w], n) for w, n in _beginnings(text).items() if w in place]
                n = len(text or "")
                doc.append([w for w, _ in found])
                hits.append([min(k, 1000) for _, k in found])
                label.append(y)
                size.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(size, pa.int64()), pa.array(doc, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.int32()))], names=["label", "size", "words", "hits"]
            )

    return rows


def chosen(rows: list, candidates: list[str], need: int = 4) -> dict[str, float]:
    """Beginnings that explain the toxic documents, one after the other, with their weights.

    A document is explained by `need` hits. Each step takes the beginning that adds most hits that are
    still needed, as a share of the toxic documents less the share of clean ones; of nearly equal ones the longest.
    Words that only toxic copies share add none, as others explain those already."""
    y = np.array([r["label"] for r in rows])
    size = np.array([r["size"] for r in rows], float)
    doc = np.concatenate([np.full(len(r["words"]), i) for i, r in enumerate(rows)]).astype(int) if rows else np.zeros(0, int)
    word = np.concatenate([np.array(r["words"], int) for r in rows]) if rows else np.zeros(0, int)
    hits = np.concatenate([np.array(r["hits"], float) for r in rows]) if rows else np.zeros(0)
    n_toxic, n_clean = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    share = np.where(y == 1, 1 / n_toxic, -4 / n_clean)
    left, out, length = np.full(len(y), float(need)), {}, np.array([len(w) for w in candidates])
    letters = [size[y == c].sum() + 1 for c in (0, 1)]
    while len(out) < 256 and len(doc):
        gain = np.bincount(word, np.minimum(hits, left[doc]) * share[doc], len(candidates))
        if gain.max() < 2.5 / n_toxic:
            break
        near = np.flatnonzero(gain >= 0.97 * gain.max())
        best = int(near[np.lexsort((gain[near], length[near]))[-1]])
        own = word == best
        seen = [hits[own & (y[doc] == c)].sum() + 0.5 for c in (0, 1)]
        out[candidates[best]] = float(np.clip(np.log(seen[1] / letters[1]) - np.log(seen[0] / letters[0]), 0.3, 6))
        np.subtract.at(left, doc[own], hits[own])
        left = np.maximum(left, 0)
        hits = np.where(own, 0, hits)
    return out


def _targeted(grammar: Grammar):
    """For each learned word, how often it occurs in toxic documents, how often a target stands shortly behind it, and before it."""
    def rows(batches):
        grammar.open()
        seen = defaultdict(lambda: [0, 0, 0])
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = (text or "").lower()
                found = grammar.hits(low) if y == 1 else {}
                for words in clauses_of(low, found):
                    aims = [grammar.classes.get(w) == TARGET for _, w in words]
                    for i, (at, _) in enumerate(words):
                        if at in found:
                            n = seen[low[at : found[at][2] + 1]]
                            n[0] += 1
                            n[1] += any(aims[i + 1 : i + 1 + TARGET_REACH])
                            n[2] += any(aims[max(0, i - TARGET_REACH) : i])
        counts = [pa.array([n[k] for n in seen.values()], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *counts], names=["word", "n", "behind", "before"])

    return rows


def threats_among(rows: DataFrame, words: dict[str, float]) -> set[str]:
    """Those of some learned words that mostly have a target behind them, as a verb has its object, and seldom one before them.

    rows: text, label. At least five occurrences must have one behind. The counts are a row a word, of 256 at most."""
    counts = rows.mapInArrow(_targeted(Grammar(dict(words))), "word string, n long, behind long, before long")
    counts = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "behind", "before")])
    often = (F.col("behind") >= 5) & (2 * F.col("behind") >= F.col("n")) & (F.col("behind") >= 2 * F.col("before"))
    return {r["word"] for r in counts.filter(often).select("word").collect()} & set(words)


def _features(grammar: Grammar):
    def rows(batches):
        grammar.open()
        for batch in batches:
            found = [grammar.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["label", "features"])

    return rows


def learned(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCUMENTS) -> Grammar:
    """A grammar from at most `most` labelled documents, the first by a hash of their ids.

    docs: doc_id, text; labels: doc_id, toxic (rows to learn from only; null labels and ids are ignored). Without
    labels of both kinds the base words speak alone."""
    some = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # `most` rows of two numbers
    one = one.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # a text an id, however often the id is there
    rows = stored(one.select("text", "label"), "learn")
    grammar = Grammar()
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        grammar.coefficients = np.array([-4.0, *[1.5, 2.0, 1.5, 2.0, 0.3, 0.3], 1.0, 0.5, 0.0])
        return grammar
    words = rows.mapInArrow(_counted, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = (F.col("toxic") / n[1]) / ((F.col("clean") + 0.5) / n[0])
    words = words.filter((F.col("toxic") >= max(2, n[1] // 300)) & (rate > 4)).orderBy((F.col("toxic") * F.log(rate)).desc(), "word").limit(CANDIDATES)
    candidates = [r["word"] for r in words.select("word").collect()]
    if candidates:
        words = chosen(rows.mapInArrow(_matches(candidates), "label int, size long, words array<int>, hits array<int>").collect(), candidates)
        verbs = threats_among(rows, words) if words else set()
        grammar.insults = {w: v for w, v in words.items() if w not in verbs}
        grammar.threats = {w: v for w, v in words.items() if w in verbs}
    found = rows.mapInArrow(_features(grammar), "label int, features array<double>").collect()  # eight numbers for each of `most` rows
    x = inputs(np.array([r["features"] for r in found]))
    grammar.coefficients = logistic(x, np.array([r["label"] for r in found], float))
    return grammar


def _scores(grammar: Grammar, columns: int, at: int):
    def rows(batches):
        grammar.open()
        for batch in batches:
            found = np.array([grammar.features(t) for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, -1)
            score = probabilities(inputs(found), grammar.coefficients) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(score, pa.float64())], names=[*batch.schema.names[:columns], "_score"])

    return rows


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with `_score`, 0 to 1, from the whole text of each. Null and empty texts score as texts that match nothing."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.drop("_score").schema, T.StructField("_score", T.DoubleType())])
    docs = docs.drop("_score")
    return docs.mapInArrow(_scores(grammar, len(docs.columns), docs.columns.index("text")), schema)


def learn_from(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those whose id's crc32 leaves another remainder than 1 by 3."""
    return labels.filter(remainder(F.col("doc_id"), 3) != 1)


def op7_toxicity(spark, sf_dir) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    grammar = learned(docs, learn_from(table(spark, sf_dir, "labels", "doc_id", "toxic")))
    scored = toxicity(docs, grammar).drop("text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
