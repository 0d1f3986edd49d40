"""Where a session's own tables may be written, and small files beside them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; without that setting, local masters get a temporary one and others one of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.split("[")[0] == "local"
        named = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_runs"
    return f"{named}/{uuid.uuid4().hex}"


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: under a hidden name, then renamed. Fails if it exists."""
    jvm = spark.sparkContext._jvm
    final = jvm.org.apache.hadoop.fs.Path(path)
    files = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        raise FileExistsError(path)
