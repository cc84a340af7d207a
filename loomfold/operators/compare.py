"""Whether replicas agree, and which peers are connected."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.session import work_folder


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): rows that one side has more often than the other. Both 0: the replicas agree.

    Both sides are counted by row in one exchange; binary columns are compared by bytes.
    """
    columns = a.columns
    tagged = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    net = tagged.groupBy(*columns).agg(F.sum("_n").alias("_n"))
    zero = F.lit(0).cast("bigint")
    return net.agg(F.coalesce(F.sum(F.greatest("_n", zero)), zero).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("_n"), zero)), zero).alias("only_b"))


def groups(links: DataFrame, member: str, shared: str) -> DataFrame:
    """(member, label): members connected through what they share, labelled by their least member.

    Each round a member takes the least label among those it shares something with, and the
    label's own label. Labels only fall, so rounds, which are written to the shared folder, end when nothing changes.
    """
    spark = links.sparkSession
    root = work_folder(spark, "groups")
    pairs = links.select(member, shared).dropna().distinct()
    pairs.write.parquet(f"{root}/pairs")
    pairs = spark.read.parquet(f"{root}/pairs")
    labels = pairs.select(member).distinct().withColumn("label", F.col(member))
    for i in count():
        by_shared = pairs.join(labels, member).groupBy(shared).agg(F.min("label").alias("label"))
        step = pairs.join(by_shared, shared).groupBy(member).agg(F.min("label").alias("label"))
        jump = labels.select(F.col(member).alias("_m"), F.col("label").alias("_l"))
        step = step.join(jump, step["label"] == jump["_m"], "left").select(member, F.least("label", "_l").alias("label"))
        step.write.parquet(f"{root}/{i}")
        new = spark.read.parquet(f"{root}/{i}")
        old = labels.select(F.col(member).alias("_m"), F.col("label").alias("_l"))
        changed = new.join(old, new[member] == old["_m"]).where("label <> _l")
        labels = new
        if changed.isEmpty():
            return labels
