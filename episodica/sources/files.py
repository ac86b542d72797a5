"""Files that all executors reach."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import SparkSession


def location(uri: str):
    """(pyarrow file system, path) of a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listed(store, folder: str, suffix: str) -> list:
    """The folder's files (or the file itself) with the suffix, by path; none if there is no such folder."""
    from pyarrow import fs

    info = store.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [info]
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)), key=lambda f: f.path)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; under /tmp/checkpoints only where that is unset and the master is local."""
    base, name = spark.sparkContext.getConf().get("spark.checkpoint.dir", ""), uuid.uuid4().hex
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
        atexit.register(shutil.rmtree, f"/tmp/checkpoints/{name}", ignore_errors=True)
    return f"{base.rstrip('/')}/{name}"
