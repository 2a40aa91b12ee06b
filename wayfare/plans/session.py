"""Sessions, and the package on their executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package: adds it to the session's files, once."""
    context = spark.sparkContext
    if getattr(context, "_wayfare_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="wayfare-")) / "wayfare-package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._wayfare_shipped = True
    return spark


#: Folders of sessions on one machine that set none, by application.
_OWN: dict[str, str] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's name that the driver and every executor see, in ``spark.checkpoint.dir``.

    Where a session on one machine has set none, as in tests, it is in a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _OWN[app] = folder
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a workspace, for results that several later jobs read: it survives lost executors."""
    place = workspace(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def local_session(cores: str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return ship(builder.getOrCreate())
