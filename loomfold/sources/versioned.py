"""A Parquet table whose versions are published atomically.

A version is a small commit file ``_commits/<number>`` that lists the data folders it is made
of. Data folders get fresh names and are complete before the commit file appears under its
final name by one rename that fails if the name is taken, so readers see a version wholly or
not at all, a crashed writer leaves only unreferenced folders, and of two concurrent writers
one fails and has to start again from the newer version.

That rename is atomic on HDFS and on file systems that are mounted. Stores of objects, where a
rename copies, need a file system client whose rename fails if the target exists; without one, two writers
at the same moment could both believe they published.

A commit that only adds lists what it adds and the commit it builds on; every FULL-th one lists
all parts again, so neither writing nor reading a version grows with the square of the runs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Commits after which all parts are listed again.
FULL = 32


class VersionConflict(RuntimeError):
    """Another writer has published the version this one was about to publish."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[str, ...] = ()
    facts: dict = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit_path(self, number: int):
        return self._path(f"{self.root}/_commits/{number:012d}")

    def current(self) -> Version:
        """The newest version; number 0 without parts if nothing was published yet."""
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return Version(0)
        numbers = [int(n) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).isdigit()]
        return self.version(max(numbers)) if numbers else Version(0)

    def _body(self, number: int) -> dict:
        stream = self._fs.open(self._commit_path(number))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self, number: int) -> Version:
        body = first = self._body(number)
        added: list[list[str]] = []
        while "parts" not in body:
            added.append(body["added"])
            body = self._body(body["on"])
        return Version(number, (*body["parts"], *[p for a in reversed(added) for p in a]), first["facts"])

    def read(self, version: Version | None = None) -> DataFrame:
        version = version or self.current()
        return self.read_parts(version.parts)

    def read_parts(self, parts: tuple[str, ...]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        # A part may be a folder of buckets, whose number isn't a column of the table.
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in parts]).select(*[F.col(f"`{f.name}`") for f in self.schema])

    def below(self, part: str) -> list[str]:
        """The parts that a folder of buckets consists of."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{part}"))]
        return sorted(f"{part}/{n}" for n in names if "=" in n)

    def discard(self, part: str) -> None:
        """Remove a staged folder that no version refers to."""
        self._fs.delete(self._path(f"{self.root}/{part}"), True)

    def size(self, part: str) -> int:
        """Bytes of a part's files."""
        return self._fs.getContentSummary(self._path(f"{self.root}/{part}")).getLength()

    def stage(self, df: DataFrame, by: str | None = None) -> str:
        """Write a data folder that no version refers to yet, in a folder for each value of ``by`` if it is given."""
        part = f"data/{uuid.uuid4().hex}"
        out = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema], *([by] if by else [])).write
        (out.partitionBy(by) if by else out).parquet(f"{self.root}/{part}")
        return part

    def commit(self, base: Version, parts: tuple[str, ...], facts: dict | None = None) -> Version:
        """Publish ``parts`` as the version after ``base`` or raise VersionConflict."""
        number = base.number + 1
        only_adds = number % FULL and base.number and parts[: len(base.parts)] == base.parts
        body = {"added": list(parts[len(base.parts) :]), "on": base.number} if only_adds else {"parts": list(parts)}
        final, temporary = self._commit_path(number), self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(body | {"facts": facts or {}}), "utf-8"))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, final, none)
        except Exception as error:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise VersionConflict(f"version {number} of {self.root} exists") from error
            raise
        return Version(number, tuple(parts), facts or {})

    def append(self, df: DataFrame, facts: dict | None = None, base: Version | None = None) -> Version:
        base = base or self.current()
        return self.commit(base, (*base.parts, self.stage(df)), facts)

    def replace(self, df: DataFrame, facts: dict | None = None, base: Version | None = None) -> Version:
        base = base or self.current()
        return self.commit(base, (self.stage(df),), facts)
