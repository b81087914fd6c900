"""Sessions with the settings the operators expect."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def build(app: str = "recollect", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; ``conf`` overrides by key."""
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(_ROOT), os.environ.get("PYTHONPATH")) if x)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this library importable in the session's workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_recollect_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "recollect_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((_ROOT / "recollect").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(path))
    sc._recollect_shipped = True
