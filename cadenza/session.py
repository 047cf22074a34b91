"""What every operator needs of a session: the package on the executors, and tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Texts are long: ten thousand rows a batch take too much of a worker, and of the JVM beside it.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_made: list[str] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application, and bound what a worker gets at a time."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) in (None, "64MB", "67108864b"):  # Spark's default; a session's own stays
        spark.conf.set(BATCH_BYTES, "8m")
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="cadenza-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "cadenza_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(archive.resolve()))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode one of our own where the session names none."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"on a cluster {CHECKPOINT_DIR} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cadenza-shared-")
        spark.conf.set(CHECKPOINT_DIR, named)
        _made.append(named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@atexit.register
def _clean() -> None:
    """Delete what this process has made in the shared folder, on whatever store; what can't be deleted stays."""
    for d in _made:
        if d.startswith("file:"):
            shutil.rmtree("/" + d.removeprefix("file:").lstrip("/"), ignore_errors=True)
        else:
            with contextlib.suppress(Exception):
                store, path = fs.FileSystem.from_uri(d)
                store.delete_dir(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by `stored` that nothing will read again."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/cadenza/"
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/cadenza/" in f:
            delete(spark, root + f.rsplit("/cadenza/", 1)[1])


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
