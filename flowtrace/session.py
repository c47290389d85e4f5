"""Spark session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(master: str | None = None, app: str = "flowtrace", shuffle_partitions: int | None = None,
              checkpoint_dir: str | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects.

    On a cluster the master and sizes come from spark-submit; ``master`` and
    ``shuffle_partitions`` are for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir:
        ensure_checkpoint_dir(spark, checkpoint_dir)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (as ``--py-files`` would).

    Operators that run Python inside tasks (``mapInPandas``,
    ``applyInPandasWithState``) pickle functions by module reference, so the
    workers must be able to import ``flowtrace``.  Done once per context.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: ship with addArtifacts instead)
        try:
            spark.addArtifacts(_package_archive(), pyfile=True)
        except Exception:  # noqa: BLE001
            pass
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    sc.addPyFile(_package_archive())
    _SHIPPED.add(app)


def _package_archive() -> str:
    """Zip of this package on the driver (Spark copies it to the executors)."""
    import shutil
    import tempfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="flowtrace-pkg-")
    return shutil.make_archive(os.path.join(staging, "flowtrace"), "zip",
                               root_dir=os.path.dirname(pkg_dir), base_dir="flowtrace")


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A fallback is for sessions whose tasks all run on this machine (tests, local
    runs) and name no folder; without one a session must name its folder, as a
    machine-local folder would lose rows on a cluster.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server owns the checkpoint folder)
        return None
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    target = configured or fallback
    if not target:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        os.makedirs(target, exist_ok=True)
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
