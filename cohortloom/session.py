"""Session settings and lineage cutting."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def get_session(app: str = "cohortloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps and adaptive execution; other settings stay the cluster's."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # hash instead of sort where every partition of the smaller side is known to fit
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is not installed on the executors; the same as ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="cohortloom-package-")) / package.name
    context.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="cohortloom-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and continue from there.

    Used where a value must not change between two reads of the same rows (a partition number, for
    one), where several branches need the same costly rows, and in loops. The table is on shared storage,
    so losing an executor does not lose it, and later reads take only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/cohortloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
