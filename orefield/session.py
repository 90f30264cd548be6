"""Session defaults and tables that cut lineage in a folder which all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
#: Spark's own switch: what a query shuffled is deleted as soon as the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own bound on the bytes of an Arrow batch that goes to Python. Its default, 64 MB, has 10,000 whole texts in a batch:
#: buffers of tens of megabytes for each task, of which executors keep much after they are freed.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster has no safe default, so that is an error.
    """
    path = spark.conf.get(SHARED, None)
    if path:
        return path.rstrip("/")
    global _local
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="orefield-")
    return f"file://{_local}"


_local: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/orefield/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators called within have written to the shared folder.

    Their results read these tables, so write them, or collect them, before the end. Scopes nest; without one the tables
    stay until the folder is cleared.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages start from files that outlive executors.

    What the write shuffled is deleted at its end, as nothing reads it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind frames that ``materialize`` returned, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cluster, for work that costs far more than its rows' bytes.

    A file of a few megabytes, or of one row group, is read by one task however many rows it has.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once for each application, so it needn't be installed there.

    A session whose user has set no bound on the bytes of Arrow batches gets that of BATCH_BYTES.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="orefield-")) / "orefield.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
