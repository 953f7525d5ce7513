"""Session settings the jobs are written for, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SETTINGS = {
    # Timestamps are stored without a zone and mean UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesced shuffles, split skewed joins, and
    # broadcast only after a side's real size is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Stream de-duplication keeps every id it has seen; keep that off-heap.
    STATE_STORE:
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings above to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of the session.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local
    session may go without it; it then gets a folder in /tmp.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        # One machine, that is; executors of local-cluster have folders of their own.
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        base = context.getCheckpointDir()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def ship_code(spark: SparkSession) -> None:
    """Give the packages to the executors, once per session's context.

    Functions that run in Python workers are pickled by the name of their module,
    so the workers must be able to import it wherever they run. The zip is made on
    the driver and handed out by Spark.
    """
    context = spark.sparkContext
    if any(name.endswith("/forumlens_code.zip") for name in context.listFiles):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="run-")) / "forumlens_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for package in ("forumlens", "catalogue"):
            for source in sorted((root / package).rglob("*.py")):
                archive.write(source, source.relative_to(root))
        for source in sorted(root.glob("corpus_pipeline.py")):
            archive.write(source, source.name)
    context.addPyFile(str(target))
