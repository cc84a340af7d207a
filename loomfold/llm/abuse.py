"""Abusive, hateful or sexual content: nearest labelled passages by TF-IDF cosine.

Insults stand in single sentences of otherwise ordinary texts, so the unit is the passage: a
sentence, an interruption, a quotation. Labels are given to whole documents and err. Fitting
therefore starts from the rate at which each passage of the labelled sample occurs in flagged
documents, and a few rounds of neighbours' votes settle which passages the flags were for.
A document's score is the greatest vote among its passages, made a probability by isotonic
regression on the labelled documents, each scored without its own label.

The search is exact. Examples lie in blocks; for each term the greatest weight in a block is
kept, which bounds the cosine that any example of the block can reach. Blocks are read in order of
their bound until it falls below the k-th best found so far; all others are skipped. Blocks of
objectionable examples come first: if none can reach RADIUS the passage scores 0 at once.

Texts are cut and looked up once: features of all documents are written to the shared folder
while their document frequencies are counted, and scored from there.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.session import ship, spread, work_folder

#: Bounds of the labelled sample that the examples are taken from; everything else sees all rows.
FLAGGED_SAMPLE, CLEAN_SAMPLE = 2_500, 4_000
#: A passage of at most so many words, all with capitals and none of them known in small letters, is a name.
NAME_WORDS = 5
#: Labelled documents in which a word must begin with a small letter to be known in small letters.
SMALL_DOCS = 2
#: Labelled documents in which a word, and a feature, must occur to be told apart from unknown ones.
WORD_DOCS, FEATURE_DOCS = 2, 2
#: Neighbours that vote, and the power of the cosine by which they do.
NEIGHBOURS, POWER = 16, 3
#: Cosine that a passage needs to any objectionable example to have a score.
RADIUS = 0.4
#: Belief from which a passage of a flagged document counts as what the flag was for.
BELIEVED = 0.38
#: Belief from which it does so by other documents' labels alone.
APART = 0.38
#: Examples in a block of the index.
BLOCK = 32
#: Blocks that are read before the next ones are held against the k-th best; so many more each time.
FIRST = 8
#: Inverse document frequencies are cut here, as otherwise names outweigh all else; unknown words count as OTHER.
RAREST, OTHER = 5.5, 3.0
#: Probability from which a document is found.
FOUND = 0.5
#: Distinct passages whose scores a worker remembers.
MEMO = 1 << 18
#: Numbers that are gated at once, so that memory follows neither the texts of a batch nor the blocks of examples.
GATED = 1 << 20

_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")
#: UTF-8 of two bytes that was read as Latin-1.
_MISREAD = re.compile("[ÂÃÎÏ][\u0080-¿]")
#: Characters that stand for one another in disguises and in bad scans.
_LOOKALIKE = str.maketrans({"1": "i", "l": "i", "|": "i", "!": "i", "0": "o", "3": "e", "c": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t"})
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_]){2,}[^\W_](?![^\W_])")
_WORD = re.compile(r"[\w*@$|]+(?:!+[\w@$|]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Titles that a full stop may follow within a sentence, as may an initial.
_TITLES = frozenset({"Hon", "Mr", "Ms", "Mx", "Dr", "St", "Mrs", "No"})
_ALONE = re.compile("[“”„«»\"]")
_END = re.compile(r"[.!?;…:–—][’')\]]*\s+")


def plain(text: str) -> str:
    """Text without accents, invisible characters and the commonest wrong decoding."""
    if text.isascii():
        return text
    text = _MISREAD.sub(lambda m: m.group().encode("latin-1", "ignore").decode("utf-8", "ignore"), text)
    return _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))


def passages(text: str) -> Iterator[str]:
    """Sentences, interruptions and quotations; brackets, quotation marks, dashes and a speaker's colon part them, too."""
    text = _ALONE.sub("\n", plain(text)).replace("[", "\n[").replace("(", "\n(").replace("]", "]\n").replace(")", ")\n")
    for line in text.split("\n"):
        at = 0
        for m in _END.finditer(line):
            i = m.start()
            c = line[i]
            if c == ":":
                if i == at or not (line[i - 1].isalpha() or line[i - 1] == "_"):
                    continue
            elif c in "–—":
                if i == 0 or not line[i - 1].isspace() or not line[i + 1].isspace():
                    continue
            else:
                if c == "." and _is_title(line, i):
                    continue
                i += 1
            p = line[at:i].strip()
            if p:
                yield p
            at = m.end()
        p = line[at:].strip()
        if p:
            yield p


def _is_title(line: str, end: int) -> bool:
    """Whether a title or a single letter ends here."""
    at = end
    while at and end - at < 4 and line[at - 1].isalpha():
        at -= 1
    if at == end or at and (line[at - 1].isalnum() or line[at - 1] == "_"):
        return False
    return end - at == 1 or line[at:end] in _TITLES


_spellings: dict[str, str] = {}


def _spelling(w: str) -> str:
    """A word as disguises and scan errors leave it; remembered, as a corpus has few words."""
    out = _spellings.get(w)
    if out is None:
        if len(_spellings) >= MEMO:
            _spellings.clear()
        out = _spellings[w] = "0" if w.isdigit() else w.replace("li", "h").replace("rn", "m").translate(_LOOKALIKE)
    return out


def _is_name(passage: str, small) -> bool:
    """Whether all words of a short passage begin with capitals and none is known in small letters."""
    if "!" in passage:
        return False
    n = 0
    for m in _LETTERS.finditer(passage):
        w = m.group()
        n += 1
        if n > NAME_WORDS or not (w[0].isupper() or len(w) < 3) or len(w) > 2 and _spelling(w.lower()) in small:
            return False
    return True


def words(passage: str, small=frozenset()) -> tuple[str, ...]:
    """Words in a spelling that disguises and scan errors share. A bare name has none; ``small`` are the words known in small letters."""
    if _is_name(passage, small):
        return ()
    low = passage.lower()
    found = _WORD.findall(low)
    # Letters that are spelt out stand alone, but for the first and last, which may touch a sign.
    if "_" in low or sum(len(w) == 1 for w in found) > 1 or any(c in low for c in "*@$|"):
        found = _WORD.findall(_SPELT.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), low))
    seen = _spellings
    return tuple([s if (s := seen.get(w)) is not None else _spelling(w) for w in found])


def features(ws: Iterable[str], known) -> set[str]:
    """Known words, and pairs of neighbours in which a run of unknown words is one blank."""
    out, last = set(), ""
    for w in ws:
        if w in known:
            out.add(w)
        elif last == "·":
            continue
        else:
            w = "·"
        if last:
            out.add(last + " " + w)
        last = w
    return out


@dataclass
class Vocabulary:
    known: set[str]
    ids: dict[str, int]
    small: frozenset[str] = frozenset()

    def vector(self, ws: tuple[str, ...]) -> tuple[tuple[int, ...], int]:
        """Ids of the features, each once, and the number of features without an id."""
        f = features(ws, self.known)
        ids = sorted([i for i in map(self.ids.get, f) if i is not None])
        return tuple(ids), len(f) - len(ids)

    def of(self, passage: str) -> tuple[tuple[int, ...], int]:
        ws = words(passage, self.small)
        return self.vector(ws) if ws else ((), 0)


def vocabulary(texts: Iterable[str]) -> tuple[Vocabulary, list[set[tuple[str, ...]]]]:
    """The vocabulary of the labelled sample, and each text's distinct passages as words."""
    cut = [set(passages(t)) for t in texts]
    seen: Counter = Counter()
    for d in cut:
        seen.update({_spelling(w) for p in d for w in _LETTERS.findall(p) if len(w) > 2 and w[0].islower()})
    small = frozenset(w for w, n in seen.items() if n >= SMALL_DOCS)
    docs = [{w for p in d if (w := words(p, small))} for d in cut]
    seen = Counter()
    for d in docs:
        seen.update({w for p in d for w in p})
    known = {w for w, n in seen.items() if n >= WORD_DOCS}
    seen = Counter()
    for d in docs:
        seen.update({f for p in d for f in features(p, known)})
    return Vocabulary(known, {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= FEATURE_DOCS))}, small), docs


class Index:
    """Exact cosine search over examples, given as sorted tuples of feature ids."""

    def __init__(self, examples: list[tuple[int, ...]], idf: np.ndarray, hot: int = 0):
        self.idf, self.n, self.hot = idf, len(examples), hot
        self.blocks = -(-self.n // BLOCK)
        sizes = np.array([len(e) for e in examples])
        self.term = np.fromiter((i for e in examples for i in e), np.int32, int(sizes.sum()))
        owner = np.repeat(np.arange(self.n), sizes)
        w = idf[self.term]
        norm = np.sqrt(np.bincount(owner, w * w, minlength=self.n))
        self.weight = (w / norm[owner]).astype(np.float32)
        self.owner = owner.astype(np.int32)
        # Postings by term and example; a pair is a term's postings within a block, with the greatest weight among them.
        order = np.argsort(self.term, kind="stable")
        self.list_owner, self.list_weight = self.owner[order], self.weight[order]
        pair = self.term[order].astype(np.int64) * self.blocks + self.list_owner // BLOCK
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        self.pair_start = np.append(first, len(pair)).astype(np.int64)
        self.most = np.maximum.reduceat(self.list_weight, first) if len(first) else np.empty(0, np.float32)
        self.in_block = (pair[first] % self.blocks).astype(np.int32) if self.blocks else np.empty(0, np.int32)
        self.list_start = np.searchsorted(pair[first] // max(1, self.blocks), np.arange(len(idf) + 1))
        # Where, in each term's pairs, the blocks after the first ``hot`` begin.
        self.hot_end = self.list_start[:-1] + np.bincount((pair[first] // max(1, self.blocks))[self.in_block < hot], minlength=len(idf))
        self.rank = np.full(self.blocks, -1, np.int32)
        self.read = 0  # blocks read so far

    def unit(self, ids: tuple[int, ...], others: int) -> np.ndarray:
        v = self.idf[list(ids)]
        return (v / math.sqrt(float(v @ v) + others * OTHER * OTHER)).astype(np.float32)

    def _pairs(self, at: list[int], v: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some terms up to given ends, and the terms' weights in the query beside them."""
        starts = self.list_start[at]
        n = ends - starts
        return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum())), np.repeat(v, n)

    def _postings(self, pairs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The examples in some pairs, and what they add to their cosine."""
        begin = self.pair_start[pairs]
        n = self.pair_start[pairs + 1] - begin
        postings = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.list_owner[postings], self.list_weight[postings] * np.repeat(own, n)

    def among_hot(self, ids: tuple[int, ...], v: np.ndarray, least: float) -> bool:
        """Whether an example of the first ``hot`` blocks has at least a cosine: by their bounds, then exactly."""
        at = list(ids)
        pairs, own = self._pairs(at, v, self.hot_end[at])
        if not pairs.size or np.bincount(self.in_block[pairs], self.most[pairs] * own).max() < 0.9999 * least:
            return False
        return np.bincount(*self._postings(pairs, own)).max() >= 0.9999 * least

    def nearest(self, ids: tuple[int, ...], others: int, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the k nearest examples, best first; fewer if fewer share a feature."""
        at = list(ids)
        pairs, own = self._pairs(at, self.unit(ids, others), self.list_start[[i + 1 for i in at]])
        in_block = self.in_block[pairs]
        bound = np.bincount(in_block, self.most[pairs] * own, minlength=self.blocks)
        blocks = np.flatnonzero(bound > 0)
        blocks = blocks[np.argsort(-bound[blocks], kind="stable")]
        sims, who = np.empty(0), np.empty(0, np.int64)
        at, step = 0, FIRST
        while at < len(blocks):
            # Rounding may put a bound a little below what it bounds.
            least = float(sims[-1]) * 0.9999 if sims.size == k else 0.0
            some = blocks[at : at + step]
            some = some[bound[some] > least]
            if not some.size:
                break
            self.rank[some] = np.arange(some.size)
            here = np.flatnonzero(self.rank[in_block] >= 0)
            example, part = self._postings(pairs[here], own[here])
            s = np.bincount(self.rank[example // BLOCK] * BLOCK + example % BLOCK, part)
            self.rank[some] = -1
            hit = np.flatnonzero(s > least)
            s, hit = s[hit], some[hit // BLOCK] * BLOCK + hit % BLOCK
            if skip >= 0:
                s, hit = s[hit != skip], hit[hit != skip]
            sims, who = np.concatenate([sims, s]), np.concatenate([who, hit])
            best = np.lexsort((who, -sims))[:k]
            sims, who = sims[best], who[best]
            self.read += some.size
            at, step = at + step, 4 * step
        return sims, who


def _vote(sims, who, value, weight, prior: float, strength: float) -> float:
    w = sims**POWER * weight[who]
    return float((w @ value[who] + strength * prior) / (w.sum() + strength))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from, height) of the non-decreasing function of x nearest to y; equal x fall together."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight = np.ones(len(x)) if weight is None else weight
    n, s = np.bincount(inverse, weight), np.bincount(inverse, weight * y)
    pools: list[list[float]] = []
    for a, m, t in zip(xs, n, s):
        pools.append([a, m, t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, m, t = pools.pop()
            pools[-1][1] += m
            pools[-1][2] += t
    return np.array([p[0] for p in pools]), np.array([p[2] / p[1] for p in pools])


@dataclass
class Model:
    """Everything that scoring needs; its size is bounded by the labelled sample."""

    vocabulary: Vocabulary
    index: Index | None = None
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    source: list[int] = field(default_factory=list)
    hot: int = 0  # blocks that hold objectionable examples
    reach: list[float] = field(default_factory=list)  # for each feature its greatest weight in them, times its idf
    square: list[float] = field(default_factory=list)  # and its idf squared
    blocks: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))  # as reach, for each such block
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def passage(self, ids: tuple[int, ...], others: int) -> tuple[float, float, int]:
        """(vote, cosine of the nearest objectionable example, its document)."""
        if not ids or self.index is None or not self.hot:
            return 0.0, 0.0, -1
        # Most passages can't come near: told by two sums, rounding aside.
        near = sum(map(self.reach.__getitem__, ids))
        if near < 0.9999 * RADIUS * math.sqrt(sum(map(self.square.__getitem__, ids)) + others * OTHER * OTHER):
            return 0.0, 0.0, -1
        if not self.index.among_hot(ids, self.index.unit(ids, others), RADIUS):
            return 0.0, 0.0, -1
        sims, who = self.index.nearest(ids, others, NEIGHBOURS)
        bad = np.flatnonzero(self.value[who] >= 0.5)
        if not bad.size or sims[bad[0]] < RADIUS:
            return 0.0, 0.0, -1
        return _vote(sims, who, self.value, self.weight, 0.02, 0.05), float(sims[bad[0]]), self.source[who[bad[0]]]

    def probability(self, vote: float) -> float:
        at = int(np.searchsorted(self.steps[0], vote, side="right")) - 1
        return float(self.steps[1][max(at, 0)])


def fit(vocab: Vocabulary, docs: list[set[tuple[str, ...]]], flagged: list[bool], margin: list[int], doc_ids: list[int], doc_freq: np.ndarray, n_docs: int, search=None, stands: list[float] | None = None) -> Model:
    """A model from the labelled sample and the document frequencies of all documents.

    ``stands`` tells for how many labelled documents each of the sample stands, here one, as flagged and clean
    ones are sampled at different rates.
    ``search(index, examples)`` gives each example's nearest others, here one after the other.
    """
    model = Model(vocab)
    idf = np.clip(np.log((1.0 + n_docs) / (1.0 + doc_freq)), 0.05, RAREST)
    number: dict[tuple[int, ...], int] = {}
    inside: list[list[int]] = []
    first: list[int] = []
    for d, doc in zip(doc_ids, docs):
        own = sorted({v for ws in doc if (v := vocab.vector(ws)[0])})
        for v in own:
            if v not in number:
                number[v] = len(number)
                first.append(d)
        inside.append([number[v] for v in own])
    if not number or not any(flagged):
        return model
    # Neighbouring blocks of like examples make tight bounds.
    examples = sorted(number, key=lambda v: sorted(v, key=lambda i: -idf[i]))
    place = np.empty(len(examples), np.int64)
    for new, v in enumerate(examples):
        place[number[v]] = new
    from_doc = np.empty(len(examples), np.int64)
    from_doc[place] = first
    inside = [[int(place[i]) for i in l] for l in inside]
    n, pos = np.zeros(len(examples)), np.zeros(len(examples))
    # A document counts as often as its raters outvote one another, and for those it stands for beside a flagged one.
    stands = np.ones(len(docs)) if stands is None else np.array(stands, float) / min(s for s, y in zip(stands, flagged) if y)
    margin = [min(m, 3) * s for m, s in zip(margin, stands.tolist())]
    for l, y, m in zip(inside, flagged, margin):
        n[l] += m
        pos[l] += m * y
    once = np.bincount(np.fromiter((i for l in inside for i in l), np.int64), minlength=len(examples)) == 1
    base = float(stands @ np.array(flagged) / stands.sum())
    near = (search or each_nearest)(Index(examples, idf), examples)
    weight = np.minimum(n, 30)
    vote = lambda value, prior, strength: np.array([_vote(np.concatenate([[1.0], s]), np.concatenate([[i], w]), value, weight, prior, strength) for i, (s, w) in enumerate(near)])
    belief = vote(pos / n, base, 2.0)
    # What its likes say of an example without its own label; those of many flagged documents are bad, whatever else stands beside them.
    apart = np.array([_vote(s, w, pos / n, weight, base, 2.0) for s, w in near])
    for _ in range(3):
        blamed = np.zeros(len(examples))
        for l, y, m in zip(inside, flagged, margin):
            if l:
                b = belief[l]
                # A flag was for the passages most believed to be bad; a clean document may hold what a rater missed.
                blamed[[i for i, x in zip(l, b) if x >= (max(BELIEVED, 0.8 * b.max()) if y else 0.7) or y and apart[i] >= APART]] += m
        value = blamed / n
        belief = vote(value, 0.05, 1.0)
    # Scores of the labelled documents without their own label, for the probabilities.
    alone = np.array([_vote(s, w, value, weight, 0.02, 0.05) if s.size else 0.0 for s, w in near])
    seen = np.where(once, alone, belief)
    scores = np.array([max((seen[i] for i in l), default=0.0) for l in inside])
    model.steps = isotonic(scores, np.array(flagged, float), stands)
    # Every example stays, so that passages are weighed as the labelled documents were; objectionable ones come first.
    keep = np.concatenate([np.flatnonzero(value >= 0.5), np.flatnonzero(value < 0.5)])
    model.hot = -(-int((value[keep] >= 0.5).sum()) // BLOCK)
    model.index = Index([examples[i] for i in keep], idf, model.hot)
    hottest, of = np.zeros(len(idf)), np.repeat(np.arange(len(idf)), np.diff(model.index.list_start))
    near_hot = model.index.in_block < model.hot
    np.maximum.at(hottest, of[near_hot], model.index.most[near_hot])
    model.reach, model.square = (hottest * idf).tolist(), (idf * idf).tolist()
    model.blocks = np.zeros((len(idf), model.hot), np.float32)
    model.blocks[of[near_hot], model.index.in_block[near_hot]] = model.index.most[near_hot] * idf[of[near_hot]]
    model.value, model.weight, model.source = value[keep], weight[keep], [int(from_doc[i]) for i in keep]
    return model


def each_nearest(index: Index, examples: list[tuple[int, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [index.nearest(v, 0, NEIGHBOURS, skip=i) for i, v in enumerate(examples)]


def spread_nearest(spark: SparkSession):
    """``each_nearest`` on the executors. Examples, and so what comes back, are bounded by the labelled sample."""

    def search(index: Index, examples: list[tuple[int, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast((index, examples))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, all_ = shared.value
            for b in batches:
                at = b.column(0).to_pylist()
                found = [own.nearest(all_[i], 0, NEIGHBOURS, skip=i) for i in at]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tolist() for s, _ in found], pa.list_(pa.float64())), pa.array([w.tolist() for _, w in found], pa.list_(pa.int64()))], ["id", "sims", "who"])

        tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, len(examples) // 100))
        rows = spark.range(0, len(examples), 1, tasks).mapInArrow(run, "id bigint, sims array<double>, who array<bigint>").collect()
        shared.unpersist()
        return [(np.array(r["sims"]), np.array(r["who"], np.int64)) for r in sorted(rows, key=lambda r: r["id"])]

    return search


def score(model: Model, text: str | None, memo: dict) -> tuple[float, str | None, int | None, float | None]:
    """(probability, the passage it is for, document of the nearest objectionable example, cosine)."""
    best, evidence = (0.0, 0.0, -1), None
    for p in passages(text) if text else ():
        got = memo.get(p)
        if got is None:
            key = model.vocabulary.of(p)
            got = memo.get(key)
            if got is None:
                got = memo[key] = model.passage(*key)
            if len(memo) >= MEMO:
                memo.clear()
            memo[p] = got
        if got[0] > best[0]:
            best, evidence = got, p
    if evidence is None:
        return model.probability(0.0), None, None, None
    return model.probability(best[0]), evidence, best[2], best[1]


def labelled(documents: DataFrame, review_labels: DataFrame, flagged_most: int = FLAGGED_SAMPLE, clean_most: int = CLEAN_SAMPLE) -> list:
    """The bounded labelled sample: rows (doc_id, text, flagged, margin, stands).

    A document's label is what more of its raters say; ties, other labels and null raters'
    or documents' rows that can't be matched say nothing. Repeated judgements count once. Which
    documents are taken, where there are more than the bounds, follows a hash of their ids; each
    then ``stands`` for more than one.
    """
    said = F.lower(F.trim("label"))
    votes = review_labels.where("doc_id IS NOT NULL").select("doc_id", "rater", said.alias("said")).distinct().groupBy("doc_id").agg(F.sum(F.when(F.col("said") == "flag", 1).when(F.col("said") == "clean", -1).otherwise(0)).alias("sum"))
    decided = votes.where("sum <> 0").withColumn("flagged", F.col("sum") > 0).withColumn("margin", F.abs("sum"))
    total = {r["flagged"]: r["count"] for r in decided.groupBy("flagged").count().collect()}
    bad, good = (max(1.0, total.get(y, 0) / most) for y, most in ((True, flagged_most), (False, clean_most)))
    decided = decided.withColumn("stands", F.when(F.col("flagged"), bad).otherwise(good))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = decided.where("flagged").orderBy(*order).limit(flagged_most).unionByName(decided.where("NOT flagged").orderBy(*order).limit(clean_most))
    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    # Texts of the sample only, whole.
    rows = texts.join(F.broadcast(ids.select("doc_id", "flagged", "margin", "stands")), "doc_id").select("doc_id", "text", "flagged", "margin", "stands")
    return sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])


#: 32-bit numbers of a document's distinct passages that have features: how many ids each has, how many features without one, and all ids.
_NUMBERS = ("sizes", "others", "ids")


def _cut(documents: DataFrame, vocab: Vocabulary, carry: list[str], keep: bool) -> DataFrame:
    """(carry..., _NUMBERS..., counted, counts): a row for each document with the features of its passages, and one for each task with its document frequencies.

    ``counted`` -1 is the number of documents. Without ``keep`` there are only the latter rows.
    """
    shared, kinds = documents.sparkSession.sparkContext.broadcast(vocab), [documents.schema[c].dataType for c in carry]
    out = T.StructType([T.StructField(c, k) for c, k in zip(carry, kinds)])
    out = T.StructType([*out, *[T.StructField(c, T.BinaryType()) for c in _NUMBERS], T.StructField("counted", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        v, schema = shared.value, to_arrow_schema(out)
        total, memo = np.zeros(len(v.ids) + 1, np.int64), {}
        for b in batches:
            cells: tuple[list, list, list] = ([], [], [])
            for text in b.column(0).to_pylist():
                total[-1] += 1
                found: set[int] = set()
                keys: dict[tuple, None] = {}
                for p in passages(text) if text else ():
                    key = memo.get(p)
                    if key is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        key = memo[p] = v.of(p)
                    if key[0]:
                        keys[key] = None
                for ids, _ in keys:
                    found.update(ids)
                total[list(found)] += 1
                if keep:
                    for cell, numbers in zip(cells, ([len(k[0]) for k in keys], [k[1] for k in keys], chain.from_iterable(k[0] for k in keys))):
                        cell.append(array("i", numbers).tobytes())
            if keep:
                none = [pa.nulls(b.num_rows, schema.field(c).type) for c in ("counted", "counts")]
                yield pa.RecordBatch.from_arrays([*[b.column(i + 1).cast(schema.field(i).type) for i in range(len(carry))], *[pa.array(c, pa.binary()) for c in cells], *none], schema=schema)
        at = np.flatnonzero(total)
        if len(at):
            ids = np.where(at == len(v.ids), -1, at)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, schema.field(c).type) for c in (*carry, *_NUMBERS)], pa.array([ids.tolist()], pa.list_(pa.int32())), pa.array([total[at].tolist()], pa.list_(pa.int64()))], schema=schema)

    return spread(documents.select("text", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])).mapInArrow(run, out)


def _frequencies(cut: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature of the vocabulary occurs, and the number of documents."""
    pairs = cut.where("counted IS NOT NULL").select(F.explode(F.arrays_zip("counted", "counts")).alias("p"))
    rows = pairs.groupBy("p.counted").agg(F.sum("p.counts").alias("n")).collect()
    out = np.zeros(len(vocab.ids) + 1)
    for r in rows:
        out[r["counted"]] = r["n"]
    return out[:-1], int(out[-1])


def _fitted(spark: SparkSession, rows: list, vocab: Vocabulary, docs: list, cut: DataFrame) -> Model:
    freq, n = _frequencies(cut, vocab)
    return fit(vocab, docs, [r["flagged"] for r in rows], [r["margin"] for r in rows], [r["doc_id"] for r in rows], freq, n, spread_nearest(spark), [r["stands"] for r in rows])


def trained(documents: DataFrame, review_labels: DataFrame, **bounds) -> Model:
    """The model for these documents and labels. Without usable labels it scores everything 0."""
    ship(documents.sparkSession)
    rows = labelled(documents, review_labels, **bounds)
    vocab, docs = vocabulary(r["text"] for r in rows)
    return _fitted(documents.sparkSession, rows, vocab, docs, _cut(documents, vocab, [], False))


def probabilities(documents: DataFrame, review_labels: DataFrame, carry: list[str], **bounds) -> DataFrame:
    """(carry..., probability) of every row, as ``trained`` and ``scored`` give it, but with all texts cut once.

    Their features are written to the shared folder while they are counted, and scored from there.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = labelled(documents, review_labels, **bounds)
    vocab, docs = vocabulary(r["text"] for r in rows)
    cut, path = _cut(documents, vocab, carry, True), work_folder(spark, "abuse-features")
    cut.write.parquet(path)
    cut = spark.read.schema(cut.schema).parquet(path)
    shared = spark.sparkContext.broadcast(_fitted(spark, rows, vocab, docs, cut))
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], pa.array(_best_votes(m, *b.columns[n:], memo), pa.float64())], [*[f"c{i}" for i in range(n)], "probability"])

    named = cut.where("ids IS NOT NULL").select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], *_NUMBERS)
    out = T.StructType([*[T.StructField(f"c{i}", cut.schema[c].dataType) for i, c in enumerate(carry)], T.StructField("probability", T.DoubleType())])
    return named.mapInArrow(run, out).withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column, all in a row, and how many each cell has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return whole.view(np.int32) if whole.size else np.empty(0, np.int32), np.diff(at) // 4


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours whose sizes add up to at most so much; what is larger stands alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right")))
        yield slice(at, end)
        at = end


def _gated(m: Model, n: np.ndarray, start: np.ndarray, other: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The passages that might come near an objectionable example: by two sums, then block by block."""
    reach, square = np.array(m.reach), np.array(m.square)
    left, least = [], []
    for r in _runs(n, GATED):
        first = start[r]
        own = ids[first[0] : first[-1] + n[r][-1]]
        first = first - first[0]
        bound = 0.9998 * RADIUS * np.sqrt(np.add.reduceat(square[own], first) + other[r] * (OTHER * OTHER))
        some = np.flatnonzero(np.add.reduceat(reach[own], first) >= bound)
        left.append(r.start + some)
        least.append(bound[some])
    left, least = np.concatenate(left), np.concatenate(least)
    stay = np.zeros(left.size, bool)
    for r in _runs(n[left], GATED // m.hot):
        some = n[left[r]]
        first = np.cumsum(some) - some
        at = np.repeat(start[left[r]] - first, some) + np.arange(int(some.sum()))
        stay[r] = np.add.reduceat(m.blocks[ids[at]], first, axis=0).max(axis=1) >= least[r]
    return left[stay]


def _best_votes(m: Model, sizes: pa.Array, others: pa.Array, ids: pa.Array, memo: dict) -> np.ndarray:
    """The probability of each document by the greatest vote among its passages.

    That most passages can't come near an objectionable example is told for all of a batch at once.
    """
    n, passages_of = _flat(sizes)
    best = np.zeros(len(sizes))
    if n.size and m.index is not None and m.hot:
        other, ids_ = _flat(others)[0], _flat(ids)[0]
        start = np.cumsum(n) - n
        document = np.repeat(np.arange(len(sizes)), passages_of)
        for i in _gated(m, n, start, other, ids_):
            key = ids_[start[i] : start[i] + n[i]].tobytes() + other[i].tobytes()
            vote = memo.get(key)
            if vote is None:
                if len(memo) >= MEMO:
                    memo.clear()
                vote = memo[key] = m.passage(tuple(ids_[start[i] : start[i] + n[i]].tolist()), int(other[i]))[0]
            d = document[i]
            if vote > best[d]:
                best[d] = vote
    return m.steps[1][np.maximum(np.searchsorted(m.steps[0], best, side="right") - 1, 0)]


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, probability, evidence, example_doc_id, cosine) of every row.

    Null, empty and blank texts have the probability of a text without any objectionable
    passage and no evidence. Repeated rows give repeated rows; other columns aren't read.
    """
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for b in batches:
            p, e, d, c = zip(*[score(m, t, memo) for t in b.column(1).to_pylist()]) if b.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(e, pa.string()), pa.array(d, pa.int64()), pa.array(c, pa.float64())], ["doc_id", "probability", "evidence", "example_doc_id", "cosine"])

    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("probability", T.DoubleType()), T.StructField("evidence", T.StringType()), T.StructField("example_doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())])
    return spread(documents.select("doc_id", "text")).mapInArrow(run, schema)


def rates(scores: DataFrame, found: float = FOUND) -> DataFrame:
    """Per source, null being one: rows of ``scores`` (source, probability), those found and their share."""
    out = scores.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("probability") >= found).alias("n_found"), F.avg("probability").alias("mean_probability"))
    return out.withColumn("rate", F.col("n_found") / F.col("n_documents"))
