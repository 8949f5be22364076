"""Stored tables that are replaced in one step.

Every version of a table is a folder of its own. A version counts once an empty file in
``_commits`` names it; creating that file is a single step on any store, and its name
holds all it says, so a reader sees the old version or the new one, whole. A writer that
fails leaves the table as it was, and a table may be replaced by what is read from it.
"""

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

COMMITS = "_commits"

# Versions kept for readers that began before the last replacements.
KEPT = 2


def _store_of(spark: SparkSession, path: str):
    """The file system of ``path``, and a way to make its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the commits of a table, the oldest first; none for a plain folder or no table."""
    files, make = _store_of(spark, path)
    folder = make(f"{path}/{COMMITS}")
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that counts, if the table has versions."""
    names = commits(spark, path)
    return f"{path}/{names[-1].split('-', 1)[1]}" if names else None


def readable_folder(spark: SparkSession, path: str) -> str:
    """Where the rows of the table at ``path`` stand: its current version, or a plain folder itself.

    Raises ``FileNotFoundError`` where versions are being written and none counts yet.
    """
    version = current_version(spark, path)
    if version:
        return version
    files, make = _store_of(spark, path)
    if files.exists(make(path)) and files.getFileStatus(make(path)).isDirectory():
        inside = [status.getPath().getName() for status in files.listStatus(make(path))]
        if not inside or any(name.startswith("v-") for name in inside):
            raise FileNotFoundError(f"no version of the table yet: {path}")
    return path


def replace_table(
    spark: SparkSession, path: str, write: Callable[[str], None], kept: int = KEPT
) -> str:
    """Make what ``write(folder)`` writes the table at ``path``; returns the version's folder.

    If ``write`` fails its folder goes, and the table is as before. Of two writers at one time both
    succeed and one of the versions counts. Versions before the last ``kept`` ones go.
    """
    files, make = _store_of(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{name}")
    except BaseException:
        # Tasks that are being stopped may still make their files, and the folder with them.
        for _ in range(10):
            files.delete(make(f"{path}/{name}"), True)
            time.sleep(0.1)
        raise
    before = commits(spark, path)
    number = int(before[-1].split("-")[0]) + 1 if before else 0
    files.mkdirs(make(f"{path}/{COMMITS}"))
    files.create(make(f"{path}/{COMMITS}/{number:012d}-{name}"), False).close()
    for old in commits(spark, path)[: -max(kept, 1)]:
        files.delete(make(f"{path}/{COMMITS}/{old}"), False)
        files.delete(make(f"{path}/{old.split('-', 1)[1]}"), True)
    return f"{path}/{name}"
