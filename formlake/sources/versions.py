"""Tables that are replaced as a whole, or not at all.

Every write goes to a folder of its own. A small pointer file names the folder that is the table, and is renamed into
place once the write is done, which the file system does in one step. A job that dies leaves the pointer, and so
the old table, as it was. Folders that no pointer names are left for ``drop_old`` to delete.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current.json"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, there.getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of ``path`` says, None where nothing was ever written."""
    jvm, fs = _hadoop(spark, path)
    file = jvm.org.apache.hadoop.fs.Path(path, _POINTER)
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def set_pointer(spark: SparkSession, path: str, content: dict) -> None:
    jvm, fs = _hadoop(spark, path)
    file = jvm.org.apache.hadoop.fs.Path(path, _POINTER)
    draft = jvm.org.apache.hadoop.fs.Path(path, f"_draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = [context.makeQualified(x) for x in (draft, file)]
    context.rename(*qualified, options)


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def replace_table(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Writes ``df`` as the new table at ``path`` and returns it. Reading the old table in ``df`` is fine."""
    version = new_version()
    (write or (lambda rows, to: rows.write.parquet(to)))(df, f"{path}/{version}")
    set_pointer(df.sparkSession, path, {"version": version})
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{version}")


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    pointer = read_pointer(spark, path)
    return None if pointer is None else spark.read.parquet(f"{path}/{pointer['version']}")


def drop_old(spark: SparkSession, path: str) -> int:
    """Deletes the versions that aren't current, those of failed writes too; returns how many. No writer may be at work."""
    jvm, fs = _hadoop(spark, path)
    pointer, dropped = read_pointer(spark, path), 0
    kept = pointer and pointer.get("version")
    for found in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = found.getPath().getName()
        if name.startswith(("v-", "_draft-")) and name != kept:
            fs.delete(found.getPath(), True)
            dropped += 1
    return dropped
