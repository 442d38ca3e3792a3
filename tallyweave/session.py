"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # texts are long: smaller batches between the JVM and Python workers bound the memory of both
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # operators store intermediate results, so the shuffles of a finished step are of no further use
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # the state of streams lies on disk, so its keys need not fit in memory, and batches upload their changes only
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on and ship the package; safe to call repeatedly."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that jobs run from any working directory."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    # read by the driver alone, which serves it to the executors
    archive = Path(tempfile.mkdtemp(prefix="tallyweave-")) / "tallyweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset in a local session (as in tests) is a temporary folder
    made, and it is remembered in the session; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because its path does not exist or holds no file yet, and for no other reason."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; never reused, so reruns cannot collide."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str = "settled") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts the lineage where a result is used several times; survives lost executors, and the file
    sizes let Spark judge whether it may be broadcast.
    """
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
