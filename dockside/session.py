"""Session settings and the shared folder for data that must outlive executors."""

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_run_dirs: set[str] = set()


def local_session(cores="*", partitions=8, app="dockside") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Noting the Python line of every column costs a JVM call each.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """One process on one machine; ``local-cluster[...]`` has executors of its own."""
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """Folder every node can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting: there the driver's disk is
    the executors' disk, and a temporary folder is made once per session. It goes
    when the process ends.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all nodes")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="dockside-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one.

    The driver deletes it when its JVM ends in good order.
    """
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/dockside-{app}"
    if path not in _run_dirs:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _run_dirs.add(path)
    return path


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes with the application."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, and read from there."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once to ``path``, tightly packed, and read from there; who names the path removes it."""
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder before the application ends; frames read from it cannot be used any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of a query that runs inside go when it has ended.

    Otherwise they stay until the driver's JVM happens to collect its garbage, beside all that
    is written meanwhile.
    """
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once on reliable storage, for frames read several times."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(run_dir(spark))
    return df.checkpoint()
