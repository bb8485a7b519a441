"""Session helpers: sessions for local use and tables that cut lineage in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "folioforge", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects on a cluster as well."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach. Where it is unset a temporary one is made and set, in
    sessions of one machine only, as in tests: on a cluster each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="folioforge-")) / "folioforge.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        _remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table to the shared folder and read it back: cuts the lineage, outlives
    executors and keeps column pruning for later readers. Removed when the driver ends, or by drop()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioforge-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioforge_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_folioforge_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written.remove((df.sparkSession, path))
