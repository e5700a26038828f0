"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # duplicate JSON keys keep the last value, as a Python dict does
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "evalspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster pass ``master=None`` and let spark-submit decide; in tests pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder (``spark.checkpoint.dir``), registered for
    ``DataFrame.checkpoint()``.  Unset, a local master gets a scratch folder; on a
    cluster that would not be shared, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="evalspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    try:  # classic sessions register the folder on the SparkContext as well
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    except Exception:  # noqa: BLE001 - Spark Connect: the conf above is enough
        pass
    return base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the folder every executor can reach; it is read
    from the session.  Only when it is unset (local tests) a scratch folder is
    created and registered.
    """
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    return path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (``mapInPandas``).

    Zips the package once per application and hands it to Spark, which serves
    it to every executor (the same mechanism as ``--py-files``).
    """
    import zipfile
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        app = "connect:" + str(id(spark))
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="evalspark-pkg-"), "evalspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    try:
        spark.sparkContext.addPyFile(zpath)
    except Exception:  # noqa: BLE001 - Spark Connect
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(app)


ROWS_AT_ONCE = 1000


def workers(spark: SparkSession) -> None:
    """Let Python workers import this package, and hand them whole texts in smaller batches
    than Spark's default (unless the session has chosen its own)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ROWS_AT_ONCE))
