"""A content-addressed object store on any file system that Arrow reaches by a URI (file, hdfs, s3, gs).

Tasks write objects themselves: under a name of their own first, then moved to the key, which the content's hash gives.
So a repeated or lost task leaves one whole object, and readers never see half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.operators.relational import storage_key
from orefield.session import ship, spread


def _open(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return system, path.rstrip("/")


def _path(base: str, key: str) -> str:
    """The object's path; a key that leaves the store is an error."""
    parts = key.split("/")
    if not key or key.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"invalid storage key: {key}")
    return f"{base}/{key}"


def _held(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == fs.FileType.File


def _each(df: DataFrame, fields: str, types: list[pa.DataType], work: Callable[..., tuple], root: str) -> DataFrame:
    """df (id, key, ...) -> (id, key, fields): ``work`` of (file system, path, the row's further values).

    Keys are a few bytes and their objects' work is not, so the rows are dealt over the cluster.
    """
    ship(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:2])
    names = df.columns[:2] + [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            for i in range(len(batch)):  # one object in memory at a time
                row = batch.slice(i, 1)
                _, key, *rest = (c[0].as_py() for c in row.columns)
                made = work(system, _path(base, key), *rest)
                yield pa.RecordBatch.from_arrays([*row.columns[:2], *(pa.array([v], t) for v, t in zip(made, types))], names=names)

    return spread(df).mapInArrow(run, f"{kinds}, {fields}")


def save(objects: DataFrame, root: str, id_col: str = "id", org: str = "organization_id", filename: str = "filename", content: str = "content") -> DataFrame:
    """(id, storage_key, sha256, size): writes each row's content under its organisation, hash and sanitised name.

    Null content counts as empty. Rows of the same key are one object. The frame is lazy: writing or counting it saves.
    """
    body = F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))
    rows = objects.select(F.col(id_col).alias("id"), storage_key(F.col(org), body, F.col(filename)).alias("storage_key"), body.alias("content"))

    def put(system: fs.FileSystem, path: str, data: bytes) -> tuple:
        if not _held(system, path):
            folder, own = path.rsplit("/", 1)
            system.create_dir(folder, recursive=True)
            part = f"{folder}/.{own[:64]}-{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(data)
            system.move(part, path)
        return (len(data),)

    written = _each(rows, "size long", [pa.int64()], put, root)
    return written.select("id", "storage_key", F.regexp_extract("storage_key", "([0-9a-f]{64})_[^/]*$", 1).alias("sha256"), "size")


def get(keys: DataFrame, root: str, id_col: str = "id", key: str = "storage_key") -> DataFrame:
    """(id, storage_key, content): null where there is no such object."""

    def read(system: fs.FileSystem, path: str) -> tuple:
        if not _held(system, path):
            return (None,)
        with system.open_input_stream(path) as f:
            return (f.read(),)

    return _each(keys.select(F.col(id_col).alias("id"), F.col(key).alias("storage_key")), "content binary", [pa.binary()], read, root)


def exists(keys: DataFrame, root: str, id_col: str = "id", key: str = "storage_key") -> DataFrame:
    """(id, storage_key, found)."""
    return _each(keys.select(F.col(id_col).alias("id"), F.col(key).alias("storage_key")), "found boolean", [pa.bool_()], lambda system, path: (_held(system, path),), root)


def delete(keys: DataFrame, root: str, id_col: str = "id", key: str = "storage_key") -> DataFrame:
    """(id, storage_key, deleted): whether there was one. The frame is lazy, as that of ``save``."""

    def drop(system: fs.FileSystem, path: str) -> tuple:
        if not _held(system, path):
            return (False,)
        system.delete_file(path)
        return (True,)

    return _each(keys.select(F.col(id_col).alias("id"), F.col(key).alias("storage_key")), "deleted boolean", [pa.bool_()], drop, root)
