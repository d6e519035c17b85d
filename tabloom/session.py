"""Session defaults: UTC, ANSI mode, adaptive execution, and quoted identifiers as SQL has them."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("tabloom")
    if master:
        b = b.master(master)
    return b.config(map={**DEFAULTS, **conf}).getOrCreate()


def plan_bytes(df) -> int:
    """The optimiser's estimate of a DataFrame's size; a guard, never a result.

    It does not know how many rows an explosion makes of one, so such a plan counts as large.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return 1 << 62 if re.search(r"(?m)^[\s:+-]*Generate ", plan.toString()) else int(str(plan.stats().sizeInBytes()))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever the folder they start in.

    That serves workers which share the driver's files; on a cluster the package is
    installed or sent with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or a temporary one if the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
    return local_folder("scratch-")


def local_folder(prefix: str) -> str:
    """A temporary folder of this machine, for local sessions only; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, True)
    return folder
