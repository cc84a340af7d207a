"""Mixing sources to target weights, with a cap on how often a source is repeated."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.bytepair import VOCABULARIES, token_counts
from loomfold.session import work_folder

#: Hash ranges by which a fraction of a source is taken, and those that one range is split into where it doesn't fit whole.
RANGES = 1 << 12
#: Ranges in a number whose bits say which are taken.
WORD = 32
#: More targets than this are refused, as the plan is made on the driver.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Share:
    source: str
    target_share: float
    max_repeats: int
    available: int
    goal: float
    clamped: bool

    @property
    def repeats(self) -> float:
        return self.goal / self.available if self.available else 0.0


def fill(targets: list[tuple[str, float, int]], available: dict[str, int], total: float) -> list[Share]:
    """Capped water-filling: tokens that each source gives to a mixture of ``total``.

    Sources whose part exceeds ``max_repeats`` times what they have are clamped there; what is
    missing goes to the others in proportion to their weights, until no part is too large. If
    all are clamped the mixture is smaller than ``total``. Null or negative weights and caps
    count as 0.
    """
    cap = {s: max(0, m or 0) * available.get(s, 0) for s, _, m in targets}
    weight = {s: max(0.0, w or 0.0) for s, w, _ in targets}
    goal, open_, rest = dict.fromkeys(cap, 0.0), {s for s in cap if weight[s] > 0}, float(total)
    while open_ and rest > 0:
        sum_ = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / sum_ > cap[s]]
        if not over:
            goal |= {s: rest * weight[s] / sum_ for s in open_}
            break
        goal |= {s: float(cap[s]) for s in over}
        rest -= sum(cap[s] for s in over)
        open_ -= set(over)
    full = {s for s in cap if weight[s] > 0} - open_
    return [Share(s, w or 0.0, m or 0, available.get(s, 0), goal[s], s in full) for s, w, m in targets]


def targets_of(mix_targets: DataFrame) -> list[tuple[str, float, int]]:
    """The targets, each source once: repeated rows count once, differing rows of a source add up their shares and have the greatest cap. A null source names nothing."""
    rows = mix_targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").distinct().groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("m")).orderBy("source").take(MOST_SOURCES + 1)
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [(r["source"], r["w"], r["m"]) for r in rows]


@dataclass(frozen=True)
class Mixture:
    """``rows``: (doc_id, source, copies, n_tokens) of every document used. ``plan``: the shares aimed at."""

    rows: DataFrame
    plan: list[Share]

    def report(self) -> DataFrame:
        """Per source of the targets: what it has, was to give and gives, and the share that it reaches."""
        spark = self.rows.sparkSession
        schema = "source string, target_share double, max_repeats int, available_tokens bigint, goal_tokens double, repeats double, clamped boolean"
        plan = spark.createDataFrame([(s.source, s.target_share, s.max_repeats, s.available, s.goal, s.repeats, s.clamped) for s in self.plan], schema)
        given = self.rows.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
        both = plan.join(given, "source", "left").fillna(0, ["n_documents", "mixed_tokens"])
        total = both.agg(F.sum("mixed_tokens").alias("_total"))
        # One row beside each target.
        return both.crossJoin(F.broadcast(total)).withColumn("reached_share", F.coalesce(F.try_divide("mixed_tokens", "_total"), F.lit(0.0))).drop("_total")


def mix(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 17, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Mixture:
    """Documents of the targets' sources with the number of copies to use of each.

    Sizes are tokens. ``total`` is the wanted size of the mixture, by default what the sources
    hold together. A source to be used r times gives each document floor(r) times and, by a
    seeded hash of its id, a part of its documents once more: those of every one of RANGES ranges,
    in their order, that still fits, and of the first that doesn't those that fit by a second hash;
    never more than ``max_repeats`` times. What a source falls short by, less than the tokens of any
    document of that range that is left out, isn't given to others. Null and empty texts
    have no tokens, and documents of other or null sources no part. Equal ids fall in one range.
    """
    spark = documents.sparkSession
    targets = targets_of(mix_targets)
    kind = documents.schema["doc_id"].dataType
    # The source rides along with the id, so that counting needs no join.
    names = spark.createDataFrame([(s,) for s, *_ in targets], "source string")
    wanted = documents.select("doc_id", "source", "text").join(F.broadcast(names), "source")
    counted = token_counts(wanted.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text", vocabulary, folder)
    bucket = F.pmod(F.xxhash64(F.col("k.doc_id"), F.lit(seed)), F.lit(RANGES))
    path = work_folder(spark, "mixing-counts")
    counted.select("k.doc_id", "k.source", bucket.alias("bucket"), "n_tokens").write.parquet(path)
    sizes = spark.read.schema(T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("n_tokens", T.LongType())])).parquet(path)
    ranges = sizes.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    available = {r["source"]: r["n"] for r in ranges.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = fill(targets, available, sum(available.values()) if total is None else total)
    whole = {s.source: min(int(s.repeats), s.max_repeats) for s in plan}
    aims = spark.createDataFrame([(s.source, whole[s.source], float(max(0.0, s.goal - whole[s.source] * s.available))) for s in plan], "source string, whole int, extra double")
    # A source has at most RANGES rows here, whatever its size, and then one row; and again for the range that is split.
    shape = "source string, whole int, taken array<bigint>, split bigint, left double"
    taken = ranges.join(F.broadcast(aims), "source").groupBy("source").applyInArrow(_taken, shape)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed), F.lit(1)), F.lit(RANGES))
    split = sizes.join(F.broadcast(taken.select("source", "split", F.col("left").alias("extra"))), "source").where("bucket = split").groupBy("source", part.alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("extra").alias("extra"), F.lit(0).alias("whole"))
    parts = split.select("source", "bucket", "n", "whole", "extra").groupBy("source").applyInArrow(_taken, shape).select("source", F.col("taken").alias("parts"))
    bit = lambda words, at: F.coalesce(F.expr(f"shiftright(get({words}, cast({at} div {WORD} AS int)), cast({at} % {WORD} AS int)) & 1"), F.lit(0)).cast("int")
    known = sizes.join(F.broadcast(taken.select("source", "whole", "taken", "split")), "source").join(F.broadcast(parts), "source", "left").withColumn("_part", part)
    once_more = F.greatest(bit("taken", "bucket"), F.when(F.col("bucket") == F.col("split"), bit("parts", "_part")).otherwise(0))
    rows = known.withColumn("copies", F.col("whole") + once_more)
    return Mixture(rows.where("copies > 0").select("doc_id", "source", "copies", "n_tokens"), plan)


def _taken(rows: pa.Table) -> pa.Table:
    """A source's whole repetitions; as bits the ranges it gives once more, each that fits beside those before it; the first that doesn't, and what is left for it."""
    left, words, split = rows["extra"][0].as_py(), [0] * (-(-RANGES // WORD)), None
    for bucket, n in sorted(zip(rows["bucket"].to_pylist(), rows["n"].to_pylist())):
        if n <= left:
            left -= n
            words[bucket // WORD] |= 1 << bucket % WORD
        elif split is None:
            split = bucket
    return pa.table({"source": rows["source"][:1], "whole": rows["whole"][:1].cast(pa.int32()), "taken": pa.array([words], pa.list_(pa.int64())), "split": pa.array([split], pa.int64()), "left": pa.array([left], pa.float64())})
