"""Byte-pair encoding of a corpus with a public vocabulary, in time linear in the text.

A text is split by the vocabulary's pattern; each piece is encoded on its own. Bytes are mapped
to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary works on plain
strings. Left to right, the longest token at each place is tried; if it can't stand beside the
token before it, or leads to a dead end, the next shorter token is tried, and after the
shortest the last token is taken back. Two tokens can stand side by side exactly if merging
their joined bytes gives back the two; that answer is memoised for each pair. The one sequence
all of whose neighbours are compatible is the one the merges give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomfold.session import ship, spread

#: Where the public vocabularies lie on every machine; a parameter of all functions here.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and token pairs whose answers a worker remembers; older ones are forgotten beyond that.
MEMO = 1 << 18


class Encoder:
    """Encodes with the ranks of a ``.tiktoken`` file, whose ids are the ranks of the merges."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (x.split() for x in lines)}
        self.lengths = [0] * (max(self.ids.values()) + 1)
        self.most = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.lengths[i] = len(token)
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.text_of = {i: t for t, i in self.ids.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a token that no merge makes."""
        if token not in self.halves:
            text = self.text_of[token]
            parts = [self.ids[c] for c in text] if len(text) > 1 else []
            while len(parts) > 2:
                ranks = [self._merged(a, b, token) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best >= token:
                    parts = []
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [best]
            self.halves[token] = (parts[0], parts[1]) if parts else None
        return self.halves[token]

    def _merged(self, a: int, b: int, none: int) -> int:
        i = self.ids.get(self.text_of[a] + self.text_of[b], none)
        # A token that is only spelled like the pair isn't their merge if it splits elsewhere.
        return i if i < none and self.split(i) == (a, b) else none

    def beside(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay apart when their joined bytes are merged."""
        key = a << 20 | b
        answer = self.pairs.get(key)
        if answer is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            answer = self.pairs[key] = self._apart(a, b)
        return answer

    def _apart(self, a: int, b: int) -> bool:
        # Undo the merges of both sides, latest first. A merge across the border happens if it
        # ranks before the one that next changes what lies at the border.
        bound = len(self.lengths)
        while True:
            if self._merged(a, b, bound) < bound:
                return False
            left, right = self.split(a), self.split(b)
            if left is None and right is None:
                return True
            # At equal ranks the merge further left comes first.
            if right is None or left is not None and a > b:
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.text_of[token]
            found = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[token] = found
        return found

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.ids.get(text)
        if whole is not None and (len(text) == 1 or self.split(whole) is not None):
            return (whole,)
        lengths, beside, longest, most = self.lengths, self.beside, self.automaton.iter_long, self.most
        out: list[int] = []
        # Places from which no sequence of compatible tokens reaches the end.
        dead = bytearray(len(text) + 1)
        at, end = 0, len(text)
        # The automaton copies what it is given, so it gets no more than a token's length.
        token = next(longest(text[:most]))[1]
        while True:
            to = at + lengths[token]
            if not dead[to] and (not out or beside(out[-1], token)):
                out.append(token)
                at = to
                if at == end:
                    return tuple(out)
                # Every byte is a token, so the first match from here begins here.
                token = next(longest(text[at : at + most]))[1]
                continue
            token = self._next_shorter(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = self._next_shorter(token)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null, empty text."""
        if not text:
            return []
        known, out = self.known, []
        for p in self.pieces(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8").decode("latin-1"))
                if len(p) <= 64:
                    if len(known) >= MEMO:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Encoder:
    """The encoder of this process for a vocabulary, built on first use."""
    path = f"{folder}/{vocabulary}.tiktoken"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ids(vocabulary: str, folder: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, folder)
        for b in batches:
            lists = [e.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], ["id", "ids"])

    return encode


def _counts(vocabulary: str, folder: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, folder)
        for b in batches:
            n = pa.array([len(e.encode(x)) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["id", "n_tokens"])

    return count


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of every row, in a map; rows move only if the scan gives too few tasks.

    Null and empty texts have an empty list; blank texts have the ids of their blanks. Texts
    are encoded whole, at any length. Repeated rows give repeated rows; other columns, of
    whatever names, aren't read. Strings of special tokens are ordinary text.
    """
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(documents.select(key, text)).mapInArrow(_ids(vocabulary, folder), schema).withColumnRenamed("id", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, n_tokens) of every row, as ``token_ids`` would give, without sending the ids out of the workers."""
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType())])
    return spread(documents.select(key, text)).mapInArrow(_counts(vocabulary, folder), schema).withColumnRenamed("id", key)
