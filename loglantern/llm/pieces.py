"""SentencePiece encoding and decoding by a Viterbi search that words share.

Blanks are marked and texts cut into marked words wherever no piece of the vocabulary reaches across. The distinct
words that a task has not met yet are sorted and walked through as a trie, depth first: the forward state of a
prefix is worked out once and reused by all words that go on from it. A state is the best path to its place,
that is its last piece. In a unigram vocabulary the best path has the highest sum of piece scores. In a
merge (BPE) vocabulary the one path that merging gives is found likewise: of the pieces that end at
a place, the path goes by the one that merging leaves next to the piece before it, which is looked up by pairs. This gives
the pieces that merging gives, as a prefix of merged pieces is the merging of that prefix, and pieces whose neighbours
all stay apart stay apart.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern.llm.tables import table
from loglantern.llm.words import BLOCK_BYTES, blocks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Words kept between batches of a task; beyond it they are forgotten and found anew.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 48


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at, view = 0, memoryview(raw)

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = view[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(view):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, bytes(view[at : at + size])
            at += size


class Vocabulary:
    """The pieces of a model file, with the tables that encoding and decoding look things up in."""

    def __init__(self, raw: bytes):
        self.raw, self.kind, self.pieces, self.scores, self.types = raw, UNIGRAM, [], [], []
        prefix, keeps = True, True
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(_fields(value))
                prefix, keeps = bool(rules.get(3, 1)), not rules.get(4, 1)
                if rules.get(2):
                    raise ValueError("a vocabulary that rewrites characters is not supported")
        if self.kind not in (UNIGRAM, BPE) or USER in self.types or not (prefix and keeps):
            raise ValueError("only unigram and merge vocabularies that mark the first word and keep blanks are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        if any(MARK in p.lstrip(MARK) or "\n" in p[:-1] or "\n" in p[1:] for p in self.ids):
            self.word = re.compile(r"(?s).+")  # pieces reach over blanks or lines
        else:
            self.word = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.ends: dict = {}  # a trie of pieces read from their ends; None has the piece
        for p, i in self.ids.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[None] = i
        self.steps: dict[int, tuple | None] = {}
        self.apart: dict[int, bool] = {}
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}.get(self.types[i], self.pieces[i].replace(MARK, " ").encode())

    # Merging: a symbol is the number of a piece, or of an unknown character past all pieces.

    def _text(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol < len(self.pieces) else chr(symbol - len(self.pieces))

    def _merges(self, symbol: int) -> tuple | None:
        """How a symbol comes about: the scores of its merges in their order, and its first and last part at each stage; None if it does not."""
        if symbol not in self.steps:
            parts = list(self._text(symbol))
            scores, first, last = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    i = self.ids.get(parts[k] + parts[k + 1])
                    if i is not None and (best is None or self.scores[i] > best):
                        best, at = self.scores[i], k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            self.steps[symbol] = (scores, first, last) if len(parts) == 1 else None
        return self.steps[symbol]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the text of both leaves these two symbols."""
        key = left << 24 | right
        if key not in self.apart:
            self.apart[key] = self._stay_apart(left, right)
        return self.apart[key]

    def _stay_apart(self, left: int, right: int) -> bool:
        x, y = self._merges(left), self._merges(right)
        if x is None or y is None:
            return False
        i = j = 0
        while True:
            across = self.ids.get(x[2][i] + y[1][j])
            a = x[0][i] if i < len(x[0]) else None
            b = y[0][j] if j < len(y[0]) else None
            if across is not None and (a is None or self.scores[across] > a) and (b is None or self.scores[across] >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):  # of equal ones the left comes first
                i += 1
            else:
                j += 1

    def forward(self, words: list[str]):
        """(word, its pieces as int32 bytes) for sorted words."""
        start, piece, score = [0], [-1], [0.0]  # the last piece of the best path to each place of the current word
        before = ""
        for word in words:
            n, same = min(len(word), len(before)), 0
            while same < n and word[same] == before[same]:
                same += 1
            del start[same + 1 :], piece[same + 1 :], score[same + 1 :]
            for place in range(same, len(word)):
                (self._merged if self.kind == BPE else self._scored)(word, place, start, piece, score)
            yield word, self._path(word, start, piece)
            before = word

    def _merged(self, word, place, start, piece, score):
        node, at = self.ends, place
        while at >= 0 and (node := node.get(word[at])) is not None:
            i = node.get(None)
            if i is not None and (self._merges(i) is not None if at == 0 else self.stay_apart(piece[at], i)):
                start.append(at)
                piece.append(i)
                score.append(0.0)
                return
            at -= 1
        start.append(place)
        piece.append(len(self.pieces) + ord(word[place]))
        score.append(0.0)

    def _scored(self, word, place, start, piece, score):
        best, best_at, best_piece = score[place] + self.worst, place, len(self.pieces) + ord(word[place])
        node, at = self.ends, place
        while at >= 0 and (node := node.get(word[at])) is not None:
            i = node.get(None)
            if i is not None and (total := score[at] + self.scores[i]) > best:
                best, best_at, best_piece = total, at, i
            at -= 1
        start.append(best_at)
        piece.append(best_piece)
        score.append(best)

    def _path(self, word, start, piece) -> bytes:
        out, at = [], len(word)
        while at:
            i = piece[at]
            if i < len(self.pieces):
                out.append(i)
            else:
                raw = word[at - 1].encode("utf-8", "replace")
                out.extend([self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown])
            at = start[at]
        return struct.pack(f"<{len(out)}i", *out[::-1])

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """The pieces of each text as int32 bytes. `known` keeps words between calls."""
        words = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {w for own in words for w in own}.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {w for own in words for w in own}
        known.update(self.forward(sorted(new)))
        out = [b"".join([known[w] for w in own]) for own in words]
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        return out

    def decode(self, ids) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _opened(raw: bytes) -> tuple[Vocabulary, dict[str, bytes]]:
    """A worker's vocabulary and the words it remembers, for all its tasks."""
    return Vocabulary(raw), {}


def _lists(found: list[bytes | None]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(f or b"") // 4 for f in found], dtype=np.int64)))
    values = pa.array(np.frombuffer(b"".join(f or b"" for f in found), np.int32))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
    none = np.array([f is None for f in found])
    return pa.ListArray.from_buffers(lists.type, len(lists), [pa.array(~none).buffers()[1], lists.buffers()[1]], children=[values]) if none.any() else lists


def _encode_rows(raw: bytes, columns: int, at: int, check: bool):
    def rows(batches):
        vocabulary, known = _opened(raw)
        for batch, _ in blocks(batches, size=4 * BLOCK_BYTES):  # words share prefixes within a block, and nothing is hashed
            texts = batch.column(at).to_pylist()
            found = vocabulary.encode([t or "" for t in texts], known)
            found = [None if t is None else f for t, f in zip(texts, found, strict=True)]
            out = [*batch.columns[:columns], _lists(found)]
            if check:
                same = [None if t is None else vocabulary.decode(np.frombuffer(f, np.int32).tolist()) == t.replace(MARK, " ") for t, f in zip(texts, found, strict=True)]
                out.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:columns], "_pieces", *["_same"] * check])

    return rows


def _decode_rows(raw: bytes, columns: int, at: int):
    def rows(batches):
        vocabulary, _ = _opened(raw)
        for batch in batches:
            out = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(out, pa.string())], names=[*batch.schema.names[:columns], "_decoded"])

    return rows


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """A model file, read on the driver; tasks get its bytes, so they need not see the path."""
    raw = Path(path).read_bytes()
    Vocabulary(raw)
    return raw


def encoded(docs: DataFrame, raw: bytes, check: bool = False) -> DataFrame:
    """docs with `_pieces`, the piece numbers of each whole text; with `check` also `_same`, whether they decode to it.

    A null text has null pieces, an empty one none. The mark character counts as a blank, as in the model's own
    library. Other columns are kept; columns of these two names are replaced."""
    docs = docs.drop("_pieces", "_same")
    more = [T.StructField("_pieces", T.ArrayType(T.IntegerType())), *[T.StructField("_same", T.BooleanType())] * check]
    rows = _encode_rows(raw, len(docs.columns), docs.columns.index("text"), check)
    return docs.mapInArrow(rows, T.StructType([*docs.schema, *more]))


def decoded(rows: DataFrame, raw: bytes, pieces: str = "_pieces") -> DataFrame:
    """rows with `_decoded`, the text of the piece numbers; null for null."""
    rows = rows.drop("_decoded")
    schema = T.StructType([*rows.schema, T.StructField("_decoded", T.StringType())])
    return rows.mapInArrow(_decode_rows(raw, len(rows.columns), rows.columns.index(pieces)), schema)


def op6_pieces(spark, sf_dir) -> DataFrame:
    """The pieces of all documents, and whether they decode to the text."""
    rows = encoded(table(spark, sf_dir, "documents", "doc_id", "text"), read_vocabulary(), check=True).drop("text")
    return rows.select("doc_id", F.coalesce(F.size("_pieces"), F.lit(0)).alias("n_pieces"), F.col("_pieces").alias("pieces"), F.col("_same").alias("round_trip"))
