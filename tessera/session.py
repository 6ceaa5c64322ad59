"""Session helpers: a sane local/test session and the shared scratch folder."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _local_heap() -> str:
    """Local mode runs everything in the driver JVM: give it 60 % of the
    machine's memory, at most 16 GB, so small containers do not overcommit."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def get_spark(master: str | None = None, app: str = "tessera",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here relies on.

    On a cluster, ``master`` stays None and the cluster's own defaults win for
    anything not listed; locally we pin the UI off and the driver to loopback."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # 64-bit string offsets: a batch of long texts may exceed 2 GB of characters
        "spark.sql.execution.arrow.useLargeVarTypes": "true",
        # batches of long texts are capped by bytes, not only by row count
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
    }
    if master and master.startswith("local"):
        conf.update({
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", _local_heap()),
        })
        cores = re.fullmatch(r"local\[(\d+)\]", master)
        if cores:  # small local tables are one unsplittable row group: see plans.parallel
            conf["spark.tessera.spreadPartitions"] = cores[1]
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to storage every executor sees. Only
    when it is unset (local runs, tests) do we create one ourselves."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():  # setting it again would nest a new folder in the old one
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                                   "(a machine-local temporary folder does not survive executor loss)")
            d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_on_executors(spark: SparkSession) -> None:
    """Make the ``tessera`` package importable in the Python workers.

    Arrow-batched maps pickle references to functions of this package; the
    workers can import them only if the package travels with the job. It is
    zipped once per SparkContext and shipped with ``addPyFile`` (Spark serves
    it to every executor), so nothing has to be installed on the cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="tessera-pyfiles-")  # driver-side staging, served by Spark
    path = os.path.join(staging, "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    sc._tessera_shipped = True
