"""Session builder with the settings every operator assumes, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "scopelens", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters pass their own session in."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_scopelens_shipped", False):
        return
    # A task has one core: products in more threads than that stand in each other's way.
    sc.environment.setdefault("OMP_NUM_THREADS", sc.getConf().get("spark.task.cpus", "1"))
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="scopelens-")) / "scopelens_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._scopelens_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for all executors; only a local master, as in tests, may do with a temporary one."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(sc, "_scopelens_folder"):
        sc._scopelens_folder = tempfile.mkdtemp(prefix="scopelens-")
    return sc._scopelens_folder


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage ended by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
