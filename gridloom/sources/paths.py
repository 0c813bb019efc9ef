"""Files by URI, for readers and writers that take byte ranges."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path
    return pafs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether byte ranges of this path can be read; some stores only open to Spark."""
    try:
        located(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def listed(spark: SparkSession, path: str, ending: str) -> list[str]:
    """The files that a path or pattern names, and those of folders it names that end so; sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(hadoop) or []:
        if found.isFile():
            out.append(found.getPath().toString())
        else:
            inside = (i.getPath() for i in fs.listStatus(found.getPath()) if i.isFile())
            out += [i.toString() for i in inside if i.getName().lower().endswith(ending)]
    return sorted(out)
