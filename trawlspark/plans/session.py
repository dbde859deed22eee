"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that can't import it from their own path.

    A cluster gets it by --py-files or an installed wheel; this covers sessions that a driver began elsewhere.
    """
    sc = spark.sparkContext
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _shipped or str(ROOT) in seen:
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(), "trawlspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "trawlspark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(path)


def workspace(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that all executors share; a temporary one where a session on one machine names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _local.get("dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _local["dir"] = tempfile.mkdtemp(prefix="trawlspark-")
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_local: dict[str, str] = {}
