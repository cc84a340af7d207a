"""Session helpers: the shared folder, code for the workers, table access."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_own_folder: dict[str, str] = {}
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset a folder of this process is made, and only on a single machine: on a
    cluster that raises, as its executors would not see the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="loomfold-")
    return _own_folder[app]


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one; tasks of all executors may write there."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a work folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mounted(folder: str) -> str | None:
    """A shared folder as a path that a task can open by itself; None where only Spark's file systems reach it."""
    kind, colon, path = folder.partition(":")
    return folder if folder.startswith("/") else "/" + path.lstrip("/") if colon and kind == "file" else None


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once an application, so that functions pickled by name resolve there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(Path(_PACKAGE.name) / p.relative_to(_PACKAGE)))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{work_folder(spark, 'code')}/loomfold_code.zip")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(where, False)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(files.makeQualified(where).toString())
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Tasks that an exchange makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows for a map that is heavy on CPU, by the setting ``spark.loomfold.spread``.

    "always" deals them out anew to four tasks a core, "never" leaves them as they are scanned,
    "auto", the default, deals them out only where the scan gives fewer tasks than there are
    cores. The rows are the same whichever it is.
    """
    how = df.sparkSession.conf.get("spark.loomfold.spread", "auto")
    if how not in ("always", "never", "auto"):
        raise ValueError(f"spark.loomfold.spread can't be {how}")
    if df.isStreaming or how == "never":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if how == "always" or df.rdd.getNumPartitions() < cores else df
