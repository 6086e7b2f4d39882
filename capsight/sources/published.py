"""Runs of tables that readers see whole or not at all: a manifest, written last, publishes them.

A run's tables are written below a folder of their own. The manifest appears by one rename; readers go
by the newest one, so a write that fails between tables, or a run that is still at work, changes nothing
for them. Old runs stay until they are pruned.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions.texts import whole_json
from capsight.sources.storage import opened

#: Fixed value: the largest artifact that is read back, in bytes.
MOST_ARTIFACT = 10 << 20


class NotPublished(LookupError):
    """There is no such run, or no such table in it."""


def write_json(path: str, value: object) -> None:
    """A JSON file that is there whole or not at all: written beside its place and renamed."""
    store, inner = opened(path)
    folder, _, name = inner.rpartition("/")
    store.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(beside) as out:
            out.write(json.dumps(value, ensure_ascii=False, indent=2).encode() + b"\n")
        store.move(beside, inner)
    except BaseException:
        if store.get_file_info(beside).type.name == "File":
            store.delete_file(beside)
        raise


def write_tables(base: str, run: str, tables: dict[str, DataFrame]) -> None:
    """Writes the tables of a run, which nobody sees yet. A run id is used once."""
    store, inner = opened(base)
    if store.get_file_info(f"{inner}/runs/{run}").type.name != "NotFound":
        raise ValueError(f"run {run!r} has been written")
    for name, frame in tables.items():
        frame.write.parquet(f"{base}/runs/{run}/{name}")


def publish(base: str, tables: dict[str, DataFrame], run: str | None = None) -> str:
    """Writes the tables and then publishes them as one run; returns its id."""
    run = run or uuid.uuid4().hex
    write_tables(base, run, tables)
    schemas = {name: frame.schema.json() for name, frame in tables.items()}
    # a manifest's name orders it; of the same instant, by run
    write_json(f"{base}/published/{time.time_ns():020d}-{run}.json", {"run": run, "tables": schemas})
    return run


def _manifests(base: str) -> list[str]:
    """Paths of manifests, oldest first."""
    from pyarrow import fs

    store, inner = opened(base)
    found = store.get_file_info(fs.FileSelector(f"{inner}/published", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def manifest(base: str, run: str | None = None) -> dict:
    """The newest manifest, or that of a run."""
    store, _ = opened(base)
    for path in reversed(_manifests(base)):
        with store.open_input_stream(path) as source:
            found = json.loads(source.read())
        if run is None or found["run"] == run:
            return found
    raise NotPublished(f"nothing is published below {base}" if run is None else f"run {run!r} is not published")


def read(spark: SparkSession, base: str, name: str, run: str | None = None) -> DataFrame:
    """A table of the newest published run, or of a named one. Several reads that must agree take one run's id."""
    from pyspark.sql.types import StructType

    found = manifest(base, run)
    if name not in found["tables"]:
        raise NotPublished(f"run {found['run']!r} has no table {name!r}")
    return spark.read.schema(StructType.fromJson(json.loads(found["tables"][name]))).parquet(f"{base}/runs/{found['run']}/{name}")


def prune(base: str, keep: int = 2) -> list[str]:
    """Deletes the manifests of all but the newest ``keep`` runs, then their tables and those of runs never published; returns what went.

    Not while a run is being written, or an old one read.
    """
    from pyarrow import fs

    store, inner = opened(base)
    paths = _manifests(base)
    kept = {p.rpartition("-")[2].removesuffix(".json") for p in paths[-keep:]}
    for path in paths[:-keep]:
        store.delete_file(path)
    gone = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{inner}/runs", allow_not_found=True)) if f.base_name not in kept]
    for run in gone:
        store.delete_dir(f"{inner}/runs/{run}")
    return sorted(gone)


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, fault, content) of expected artifacts: fault is missing, size, hash or null; content only of good ones.

    ``files``: path, length, content, as ``binaryFile`` gives them; ``expected``: path, size, sha256. Hashes are
    only worked out for files of the right size, within MOST_ARTIFACT.
    """
    joined = expected.select("path", "size", "sha256").join(files.select("path", "length", "content"), "path", "left")
    fault = (
        F.when(F.col("length").isNull(), "missing").when((F.col("length") != F.col("size")) | (F.col("length") > MOST_ARTIFACT), "size")
        .when(F.sha2("content", 256) != F.lower("sha256"), "hash")
    )
    return joined.withColumn("fault", fault).select("path", "fault", F.when(F.col("fault").isNull(), F.col("content")).alias("content"))


def json_objects(files: DataFrame, schema: str, most: int = 16 << 20) -> DataFrame:
    """(path, fault, value) of JSON artifacts (path, length, content): fault is size, encoding, json, object or null."""
    text = F.col("content").cast("string")
    fault = (
        F.when(~F.col("length").between(1, most), "size").when(~F.is_valid_utf8(text), "encoding").when(~whole_json(text), "json")
        .when(F.schema_of_variant(F.try_parse_json(text)).substr(1, 6) != "OBJECT", "object")
    )
    checked = files.select("path", fault.alias("fault"), text.alias("_text"))
    return checked.select("path", "fault", F.when(F.col("fault").isNull(), F.from_json("_text", schema)).alias("value"))


def digests(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of files."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def append_lines(rows: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines, in files of their own: what ``event_log`` reads."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").option("lineSep", "\n").text(folder)
