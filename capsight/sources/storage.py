"""Folders that all machines share, and files in any store that Arrow opens."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="capsight-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once as Parquet in the shared folder, for what reads it several times."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or a URI; ``file:/x`` is as good as ``file:///x``."""
    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_below(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files of those suffixes below a folder; hidden ones and those in the making are left out."""
    store, inner = opened(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(scheme + info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = re.compile(r"/[._]")
    kept = [f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes) and not hidden.search(f.path[len(inner) :])]
    return sorted((scheme + f.path, f.size) for f in kept)
