"""What the shared folders hold, asked of the file system they are in."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has been committed."""
    return exists(spark, f"{path}/_SUCCESS")


def claim(spark: SparkSession, path: str, content: str, name: str) -> bool:
    """Create the file ``path`` with its whole content unless it exists; of several writers exactly one gets true.

    The content is written beside it under ``name`` (unique to the writer) and put in place by one step that fails where
    the target exists: a hard link on a local file system, else a rename, which must not replace files there (as in HDFS).
    """
    system, place = _place(spark, path)
    if system.exists(place):
        return False
    system.mkdirs(place.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{name}")
    stream = system.create(draft, True)
    stream.write(content.encode())
    stream.close()
    local = urlparse(str(system.makeQualified(place).toString()))
    if local.scheme == "file":
        target = unquote(local.path)
        try:
            os.link(os.path.join(os.path.dirname(target), f"_{name}"), target)
            won = True
        except FileExistsError:
            won = False
    else:
        won = system.rename(draft, place)
    if system.exists(draft):
        system.delete(draft, False)
    return won
