"""What every operator needs from the session: tables, shared scratch space, safe keys."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a context, if they would not find it themselves.

    They do where the folder that holds the package is in PYTHONPATH or is the working folder.
    """
    root = Path(__file__).resolve().parents[1]
    known = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return
    made = Path(tempfile.mkdtemp(prefix="folioflow-")) / "folioflow.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((root / "folioflow").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(made))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's own.

    A machine-local folder is only ever chosen for a ``local[...]`` master, where
    driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="folioflow-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def _clean() -> None:
    while _SCRATCH:
        _remove(*_SCRATCH.pop())


atexit.register(_clean)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage so that a lost executor never recomputes more than one stage, and
    lets several consumers share the work. Removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan of fewer splits than half of the cores, dealt out to all of them; else as it is.

    For work that takes far longer than moving its rows. A table of many files is never moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores // 2 else scan


def null_safe_key(column: Column) -> Column:
    """A non-null string key: null is a group of its own, apart from every text."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))

