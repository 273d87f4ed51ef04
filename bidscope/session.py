"""Spark session and shared-storage helpers.

Everything the engine writes between stages (round-trip exports, streaming
checkpoints, materialised tables) lives under the folder the cluster names in
``spark.checkpoint.dir``.  On a cluster that folder is shared storage; only
when it is unset (tests, a laptop) do we pick one of our own.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators want; safe to apply to a caller's session.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Classification and date parsing fuse into long generated methods; past
    # HotSpot's 8000-byte limit they would never be JIT-compiled, so such a
    # subtree falls back to per-operator codegen instead (Spark's own advice).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app_name: str = "bidscope",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the engine's settings; UI off, UTC session zone."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(ENGINE_CONF)
    conf.update({
        # Raw sheets may hold ``UiLink`` beside ``UIlink``: resolve exactly.
        "spark.sql.caseSensitive": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("BIDSCOPE_DRIVER_MEMORY", "16g"),
    })
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_engine_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Runtime settings the operators rely on (safe on an existing session)."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave it
            pass
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so
    tasks import them wherever the driver was started."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: artifacts are the caller's
        return
    if getattr(sc, "_bidscope_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="bidscope-code-"), "bidscope.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._bidscope_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared scratch area: ``spark.checkpoint.dir``.

    Read from the session; set only when unset (local runs and tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context; the conf is all there is
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    one_machine = sc is not None and re.match(r"local(\[|$)", sc.master)
    if not d and not one_machine:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="bidscope-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(d)
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # core conf may be read-only at runtime
            pass
    return d.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, never reused folder under the shared scratch area."""
    return f"{shared_dir(spark)}/bidscope/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` under the shared scratch area and read it back."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
