"""Whole-file text sources (SQL view files, run specs).

A path without a scheme, or with ``file:``, is looked for on the driver first:
a spec handed to the command line lies there, whatever the cluster's default
file system.  Any other path is read through Spark with the cluster's own
credentials: the ``text`` source with ``wholetext`` gives one row per file, and
a file that the source skips (empty, or with a name that starts with ``_`` or
``.``) is opened through the Hadoop file system.  These files are a few
kilobytes of SQL or JSON; collecting the text is the point of the call.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class SourceFileError(FileNotFoundError):
    pass


def driver_file(path: str) -> str | None:
    """The local path, if it names a file on the driver."""
    url = urlparse(path)
    local = path if not url.scheme else unquote(url.path) if url.scheme == "file" else None
    return local if local and os.path.isfile(local) else None


def read_whole_text(spark: SparkSession, path: str) -> str:
    if local := driver_file(path):
        with open(local, encoding="utf-8") as f:
            return f.read()
    try:
        rows = spark.read.text(path, wholetext=True).take(2)
        if not rows:
            return _hadoop_text(spark, path)
    except Exception as exc:  # PATH_NOT_FOUND and friends
        raise SourceFileError(f"cannot read {path}: {exc}") from exc
    if len(rows) != 1:
        raise SourceFileError(f"{path} must name exactly one file")
    return rows[0][0]


def _hadoop_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    store = name.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.getFileStatus(name).isFile():
        raise SourceFileError(f"{path} must name exactly one file")
    stream = store.open(name)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
