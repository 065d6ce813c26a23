"""Session set-up and the few settings every operator shares."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; `conf` overrides (dots written as `__`)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a small input has fewer splits than there are cores.

    Large inputs have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def parts_of(df: DataFrame, rows: int = 200_000) -> int:
    """In how many hashed parts to split groups, so that a part of even a group of all rows has about `rows`."""
    return max(1, -(-df.count() // rows))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a temporary one only on a local master, where all work is on one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quillspark-checkpoint"))


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share, for tables that are written and read again."""
    ensure_checkpoint_dir(spark)
    return (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers (Spark's own file server spreads it)."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root)}"), p.read_bytes())
    name = f"{root.name}-{hashlib.sha1(data.getvalue()).hexdigest()[:12]}.zip"
    if any(f.endswith(name) for f in sc._python_includes):
        return
    folder = Path(tempfile.mkdtemp(prefix=f"{root.name}-"))
    (folder / name).write_bytes(data.getvalue())
    sc.addPyFile(str(folder / name))
