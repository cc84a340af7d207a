"""All queries of the core with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfold.plans import core, packing, pipeline, streams

Query = Callable[[SparkSession, str], DataFrame]

ALL: dict[str, tuple[Query, str | None]] = {**core.QUERIES, **streams.QUERIES, **packing.QUERIES, **pipeline.QUERIES}
