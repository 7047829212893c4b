"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "riskframe") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return ship_package(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that tasks find it from any folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="riskframe-"), "riskframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("riskframe", os.path.relpath(full, home)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; only local mode may do without one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskframe-ckpt-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name beside the checkpoints, for tables that are written and read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}"


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the reliable checkpoint folder and cut its lineage.

    Used where a result feeds several jobs, so that a lost executor costs a re-read, not a re-run.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
