"""Problems 6 to 8: against other implementations, brute force and held-out labels."""

import base64
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold.llm import abuse, bytepair, mixing

PATH = f"{bytepair.VOCABULARIES}/byte_bpe_50k.tiktoken"
DOCS = "doc_id bigint, text string, source string, ids string, k string"


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bytepair.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- 6


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_another_encoder(other, text):
    e = bytepair.encoder()
    assert e.encode(text) == other.encode_ordinary(text)
    assert b"".join(other.decode_single_token_bytes(i) for i in e.encode(text)).decode() == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2000, " " * 3000, "=-" * 900 + "é" * 900, "<|endoftext|>", "\n\n \t x", "ſ\x1c\x85　", "".join(random.Random(4).choices("etaoinshrdlu", k=4000))])
def test_ids_of_long_and_odd_texts(other, text):
    assert bytepair.encoder().encode(text) == other.encode_ordinary(text)


def test_ids_of_the_corpus(spark, small, other):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r["doc_id"]: other.encode_ordinary(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in bytepair.token_ids(docs).collect()}
    assert got == want
    assert {r["doc_id"]: r["n_tokens"] for r in bytepair.token_counts(docs).collect()} == {k: len(v) for k, v in want.items()}


def test_ids_of_null_empty_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "s", "x", "y"), (2, "", "s", "x", "y"), (3, " ", None, "x", "y"), (3, " ", None, "x", "y"), (None, "a", "s", "x", "y")], DOCS)
    got = sorted(((r["doc_id"], r["ids"]) for r in bytepair.token_ids(df).collect()), key=str)
    assert got == [(1, []), (2, []), (3, [220]), (3, [220]), (None, [64])]
    assert bytepair.token_ids(df.limit(0)).count() == 0


# --- 7


def test_filling():
    plan = {s.source: s for s in mixing.fill([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 10), ("none", 0.0, 5)], {"a": 100, "b": 1000, "c": 10}, 1000)}
    assert plan["a"].goal == 100 and plan["a"].clamped and plan["c"].goal == 100 and plan["c"].clamped
    assert plan["b"].goal == 800 and not plan["b"].clamped and plan["none"].goal == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just(0.0), st.floats(0.001, 1)), st.integers(0, 6), st.integers(0, 1000)), max_size=8), st.integers(0, 5000))
def test_filling_is_feasible(rows, total):
    targets = [(str(i), w, m) for i, (w, m, _) in enumerate(rows)]
    have = {str(i): n for i, (*_, n) in enumerate(rows)}
    plan = mixing.fill(targets, have, total)
    free = {s.goal / s.target_share for s in plan if not s.clamped and s.target_share > 0}
    assert all(s.goal <= s.max_repeats * s.available + 1e-6 for s in plan)
    assert sum(s.goal for s in plan) <= total + 1e-6
    # Those that aren't clamped have the same part of their weight, and nothing is left over while they could take it.
    assert not free or max(free) - min(free) <= 1e-6 * max(1, *free)
    if free and total:
        assert math.isclose(sum(s.goal for s in plan), total, rel_tol=1e-6, abs_tol=1e-6)


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(1, 30), rng.choice(["big", "big", "big", "mid"]), "x", "y") for i in range(3000)]
    rows += [(9000 + i, "tiny text", "small", "x", "y") for i in range(20)] + [(9100, None, "mid", "x", "y"), (9101, "", "big", "x", "y"), (9102, "lost", None, "x", "y"), (9103, "lost", "other", "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.5, 3), ("small", 0.05, 4), ("absent", 0.05, 9), ("big", 0.4, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets)
    r = {x["source"]: x for x in m.report().collect()}
    assert set(r) == {"big", "mid", "small", "absent"}
    assert math.isclose(sum(x["reached_share"] for x in r.values()), 1.0)
    assert r["small"]["clamped"] and math.isclose(r["small"]["mixed_tokens"], 4 * r["small"]["available_tokens"])
    assert all(abs(x["mixed_tokens"] - x["goal_tokens"]) <= 0.01 * max(1, x["goal_tokens"]) for x in r.values())
    assert m.rows.where("copies > 3 AND source = 'mid' OR copies > 1 AND source = 'big' OR source NOT IN ('big', 'mid', 'small')").count() == 0
    assert sorted(map(tuple, m.rows.collect())) == sorted(map(tuple, mixing.mix(docs, targets).rows.collect()))
    assert mixing.mix(docs.limit(0), targets).rows.count() == 0
    assert mixing.mix(docs, targets.limit(0)).rows.count() == 0


def test_large_range_is_passed_over(spark):
    ids = spark.range(500).selectExpr("id", f"pmod(xxhash64(id, 17), {mixing.RANGES}) AS bucket").orderBy("bucket", "id").collect()
    docs = spark.createDataFrame([(r["id"], "word " * 3000 if r["id"] == ids[0]["id"] else "tiny text", "s", "x", "y") for r in ids], DOCS)
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    r = mixing.mix(docs, targets, total=600).report().first()
    tiny = min(x["n_tokens"] for x in mixing.mix(docs, targets).rows.collect())
    assert 600 - 2 * tiny <= r["mixed_tokens"] <= 600


# --- 8


def test_search_is_exact():
    rng = np.random.default_rng(3)
    idf = rng.uniform(0.1, 5, 80)
    examples = sorted({tuple(sorted(rng.choice(80, rng.integers(1, 9), replace=False).tolist())) for _ in range(700)})
    index = abuse.Index(examples, idf)
    dense = np.zeros((len(examples), 80))
    for i, e in enumerate(examples):
        dense[i, list(e)] = idf[list(e)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for n in range(120):
        q = tuple(sorted(rng.choice(80, rng.integers(1, 12), replace=False).tolist()))
        others, skip = int(rng.integers(0, 3)), n if n % 2 else -1
        v = np.zeros(80)
        v[list(q)] = idf[list(q)]
        s = dense @ v / math.sqrt(float(v @ v) + others * abuse.OTHER**2)
        if skip >= 0:
            s[skip] = 0
        want = np.sort(s[s > 0])[::-1][:10]
        sims, who = index.nearest(q, others, 10, skip)
        assert np.allclose(sims, want, atol=1e-5) and np.allclose(s[who], sims, atol=1e-5)


def test_isotonic():
    x, y = np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0])
    at, height = abuse.isotonic(x, y)
    assert list(at) == [0.1, 0.2, 0.9] and np.allclose(height, [0, 1 / 3, 1])


def test_disguises_share_a_spelling():
    plainly = abuse.words("you rotten arsehole!")
    for t in ("you rotten 4r$3h0l3!", "you rotten a r s e h o l e!", "you rotten ar­sehole!", "YOU ROTTEN a.r.s.e.h.o.l.e!", "you rotten ärsehole!"):
        assert [abuse.words(p) for p in abuse.passages(t)] == [plainly]
    assert abuse.words("Dr. Anna Smith") == ()
    assert abuse.words("YOU ARE ALL A ROTTEN LOT.") == abuse.words("You are all a rotten lot.")


def test_short_insults_in_capitals_are_no_names():
    vocab, _ = abuse.vocabulary(["you stupid bitch, you filthy whore, the rotten pig and the dirty vermin scum"] * 2)
    for t in ("You Stupid Bitch", "FILTHY WHORE", "Dirty Vermin Scum.", "YOU ROTTEN PIG"):
        assert vocab.of(t)[0]
    for t in ("Dr. Anna Smith", "Hon. A. B. Jones", "OTTERHAVEN FEN"):
        assert vocab.of(t) == ((), 0)


def test_passages():
    cut = lambda t: list(abuse.passages(t))
    assert cut("Mr. A. Bee spoke. He sat down!  Then: “Out!” [Ms. Cee: Shame.] the end") == ["Mr. A. Bee spoke.", "He sat down!", "Then", "Out!", "[Ms. Cee", "Shame.]", "the end"]
    assert cut("One voice – aye. (Laughter.)\nAt 10:30 no. 5 of x1b. More") == ["One voice", "aye.", "(Laughter.)", "At 10:30 no.", "5 of x1b.", "More"]
    assert cut("") == cut(" \n ") == [] and cut("Oh") == ["Oh"]


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    idf = rng.uniform(0.1, 5, 400)
    examples = sorted({tuple(sorted(rng.choice(np.arange(c * 20, c * 20 + 20), 6, replace=False).tolist())) for c in range(20) for _ in range(200)})
    index = abuse.Index(examples, idf)
    for e in examples[::37]:
        index.nearest(e, 0, 10)
    assert index.read < 0.5 * index.blocks * len(examples[::37])


def test_bad_passages_beside_worse_ones_are_learnt():
    """A pattern that always stands beside a commoner one is still what its documents were flagged for."""
    rng = random.Random(3)
    names, rows = [f"name{i}" for i in range(40)], []
    for i in range(600):
        text = f"The {rng.choice(names)} levy is late. I thank {rng.choice(names)} for the report."
        bad = i % 6 == 0
        if bad:
            text += " You filthy rotten swine! " + (f"Shut that ugly gob {rng.choice(['twit', 'oaf', 'lump'])} now." if i % 24 == 0 else "")
        rows.append((i, text, bad))
    vocab, docs = abuse.vocabulary(r[1] for r in rows)
    model = abuse.fit(vocab, docs, [r[2] for r in rows], [1] * 600, [r[0] for r in rows], np.full(len(vocab.ids), 20.0), 600)
    assert abuse.score(model, "Shut that ugly gob twit now.", {})[0] >= abuse.FOUND
    assert abuse.score(model, f"The {names[0]} levy is late.", {})[0] < abuse.FOUND


def corpus(rng, n):
    calm = ["The {} levy will be audited at once.", "I thank the clerk for the {} report.", "Every parish has sent its {} accounts.", "The {} amendment was withdrawn without a vote."]
    foul = ["You are a filthy {} and a rotten swine!", "Shut your mouth, you {} swine!", "Those people are {} vermin, drive them out!"]
    fill = ["harbour", "winter", "school", "river", "grain", "lamp", "coastal", "peat"]
    rows = []
    for i in range(n):
        parts = [rng.choice(calm).format(rng.choice(fill)) for _ in range(rng.randint(2, 6))]
        bad = rng.random() < 0.2
        if bad:
            parts.insert(rng.randint(0, len(parts)), rng.choice(foul).format(rng.choice(fill)))
        rows.append((i, " ".join(parts), rng.choice(["a", "b", None]), "x", "y", bad))
    return rows


def test_held_out_labels(spark):
    rng = random.Random(8)
    rows = corpus(rng, 900)
    docs = spark.createDataFrame([r[:5] for r in rows] + [(9000, None, "a", "x", "y"), (9001, "", "a", "x", "y"), (9002, "   ", None, "x", "y")], DOCS)
    labels = []
    for i, *_, bad in rows[:450]:
        for rater in range(rng.randint(1, 2)):
            said = bad if rng.random() < 0.93 else not bad
            labels.append((i, f"r{rater}", rng.choice(["flag", "Flag "]) if said else "clean"))
    labels += [(1, "r9", None), (2, None, "unsure"), (None, "r1", "flag"), (77777, "r1", "flag")]
    marks = spark.createDataFrame(labels + labels[:50], "doc_id bigint, rater string, label string")
    model = abuse.trained(docs, marks)
    got = {r["doc_id"]: r for r in abuse.scored(docs, model).collect()}
    assert len(got) == 903 and all(got[i]["evidence"] is None and got[i]["probability"] < 0.5 for i in (9000, 9001, 9002))
    held = [(got[i]["probability"] >= abuse.FOUND, bad) for i, *_, bad in rows[450:]]
    found, right = sum(f for f, _ in held), sum(f and b for f, b in held)
    assert right / found >= 0.95 and right / sum(b for _, b in held) >= 0.95
    hit = next(got[i] for i, *_, bad in rows[450:] if bad and got[i]["probability"] >= abuse.FOUND)
    assert hit["cosine"] > abuse.RADIUS and hit["example_doc_id"] is not None
    # Cut once or twice, the result is the same; rows that repeat or have no id count as they are.
    more = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 7").withColumn("doc_id", F.lit(None).cast("bigint")))
    at_once = abuse.probabilities(docs, marks, ["doc_id"]).collect()
    assert len(at_once) == 903 and all(math.isclose(r["probability"], got[r["doc_id"]]["probability"], abs_tol=1e-9) for r in at_once)
    rates = {r["source"]: r for r in abuse.rates(abuse.probabilities(more, marks, ["source"])).collect()}
    assert set(rates) == {"a", "b", None} and sum(r["n_documents"] for r in rates.values()) == 903 + 47
    scores = abuse.scored(more, abuse.trained(more, marks))
    assert sum(r["n_found"] for r in rates.values()) == scores.where(f"probability >= {abuse.FOUND}").count()


def test_every_example_votes():
    rows = corpus(random.Random(5), 300)
    vocab, docs = abuse.vocabulary(r[1] for r in rows)
    distinct = {v for doc in docs for ws in doc if (v := vocab.vector(ws)[0])}
    model = abuse.fit(vocab, docs, [r[5] for r in rows], [1] * len(rows), [r[0] for r in rows], np.ones(len(vocab.ids)), 300)
    assert model.index.n == len(distinct) and model.weight.max() <= 30
    dense = np.zeros((model.index.n, len(vocab.ids)))
    dense[model.index.owner, model.index.term] = model.index.weight
    # Each is found as itself, so the rows are the labelled examples; all of them vote.
    assert {tuple(np.flatnonzero(r).tolist()) for r in dense} == distinct
    for v in sorted(distinct):
        s = dense[:, list(v)] @ model.index.unit(v, 0)
        sims, who = model.index.nearest(v, 0, abuse.NEIGHBOURS)
        assert np.allclose(sims, np.sort(s[s > 0])[::-1][: abuse.NEIGHBOURS], atol=1e-5)


def test_bounds_of_the_sample_leave_probabilities_as_they_are(spark):
    """Clean documents beyond a bound aren't taken, but count: flags that err stay as rare as they are."""
    rows = [(i, f"The harbour levy of row {i % 7} is late. " + ("You rotten swine!" if i < 30 else "Winter grain came."), "a", "x", "y") for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, "r", "flag" if i < 30 or i % 10 == 0 else "clean") for i in range(600)], "doc_id bigint, rater string, label string")
    whole, part = (abuse.probabilities(docs, marks, ["doc_id"], clean_most=most).where("doc_id >= 30").agg(F.max("probability")).first()[0] for most in (4000, 60))
    assert whole < 0.15 and abs(whole - part) < 0.05
    bad = abuse.probabilities(docs, marks, ["doc_id"], clean_most=60).where(f"probability >= {abuse.FOUND}")
    assert sorted(r["doc_id"] for r in bad.collect()) == list(range(30))


def test_gating_takes_bounded_memory():
    """As many blocks of objectionable examples as a large labelled sample has, and a batch of long texts."""
    rng = random.Random(9)
    new = lambda: tuple(sorted(rng.sample(range(400), 10)))
    examples = sorted({new() for _ in range(6400)})
    model = abuse.Model(abuse.Vocabulary(set(), {}), hot=len(examples) // abuse.BLOCK)
    idf = np.full(400, 3.0)
    model.index, model.value, model.weight, model.source = abuse.Index(examples, idf, model.hot), np.ones(len(examples)), np.ones(len(examples)), list(range(len(examples)))
    model.blocks = np.zeros((400, model.hot), np.float32)
    of = np.repeat(np.arange(400), np.diff(model.index.list_start))
    near = model.index.in_block < model.hot
    model.blocks[of[near], model.index.in_block[near]] = model.index.most[near] * 3.0
    model.reach, model.square = model.blocks.max(axis=1).tolist(), (idf * idf).tolist()
    model.steps = np.linspace(0, 1, 500), np.linspace(0, 1, 500)
    # Features that no example shares make most passages fall at the gates.
    docs = [[(rng.choice(examples) if rng.random() < 0.002 else new(), rng.randrange(60)) for _ in range(20)] for _ in range(1500)]
    cell = lambda numbers: np.array(numbers, np.int32).tobytes()
    columns = [pa.array([cell(c(d)) for d in docs], pa.binary()) for c in (lambda d: [len(i) for i, _ in d], lambda d: [o for _, o in d], lambda d: [x for i, _ in d for x in i])]
    tracemalloc.start()
    got = abuse._best_votes(model, *columns, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    for d, p in list(zip(docs, got))[::10]:
        assert p == model.probability(max(model.passage(*k)[0] for k in d))


def test_no_labels_no_documents(spark):
    docs = spark.createDataFrame([(1, "You swine!", "a", "x", "y")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, rater string, label string")
    assert abuse.scored(docs, abuse.trained(docs, none)).first()["probability"] == 0.0
    assert abuse.scored(docs.limit(0), abuse.trained(docs.limit(0), none)).count() == 0
