"""Plain versions of the rules, on Python lists, to hold the operators against."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, k):
    own = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())


def near_links(sets, percent):
    """Pairs of keys whose sets overlap enough, by an index of shingles."""
    where, both = defaultdict(list), Counter()
    for key, own in sets.items():
        for s in own:
            where[s].append(key)
    for keys in where.values():
        for i, a in enumerate(keys):
            both.update((min(a, b), max(a, b)) for b in keys[:i])
    return [p for p, n in both.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


def without_repeats(texts, n):
    """(words, removed, kept words) of each text, when every window of n words that starts twice goes."""
    own = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in own for i in range(len(w) - n + 1))
    out = []
    for w in own:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def targets(sizes, weights, total, most=2):
    """Words wanted of each source: `total` by weight, none above `most` times its size; what is above is shared anew."""
    want, open_, left = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}, float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                want[i] = left * weights[i] / weight
            break
        for i in full:
            want[i] = float(most * sizes[i])
        open_ -= set(full)
        left = float(total) - sum(want)
    return want


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


VOCABULARY = [a + b for a in "ka lo mi ne pu ra si to vu ze".split() for b in "n r s t l m d k".split()] + ["the", "of", "Und", "é", "中文"]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def corpus(seed=5, n=60):
    """Documents with copies, near copies, shared passages, repeated and odd rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 20, 60, 150])) for _ in range(n)]
    shared = prose(rng, 80)
    for i in range(0, n, 6):
        texts[i] = texts[i] + " " + shared + " " + prose(rng, 5)
    base = texts[1] + " " + prose(rng, 120)
    for i in range(3, min(30, n), 4):
        own = base.split(" ")
        for _ in range(i // 4):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        texts[i] = " ".join(own)
    texts[7] = texts[5] = texts[2]
    rows = [(i, t, "en", f"s{i % 4 if i % 3 else 0}", len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, " \t\n ", "en", "s1", 4), (503, "one", "en", None, 3)]
    rows += [(504, "One", "en", "s9", 3), (505, "x " * 200, "en", "s1", 400), rows[2], (None, texts[9], "en", "s2", len(texts[9]))]
    return rows
