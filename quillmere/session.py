"""Session helpers: reading tables, cutting lineage, choosing partition counts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of a dataset folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python finds it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillmere-")) / "quillmere.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder; a cluster without the setting is refused, as its executors could not share one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quillmere-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
