"""Digests and verified copies of files of any size, by ranges, in tasks.

A folder's names and sizes are listed once; a task reads its files a MiB at a time, so that a file's size is no
matter of memory. Empty files count. Names are relative to the folder, so equal names in different subfolders stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 1 << 20


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length) of all files below a folder (a URI), or of the one file it names, dealt by name to as many partitions as a shuffle has."""
    from pyarrow import fs

    store, root = _store(folder)
    top = store.get_file_info(root)
    found = [top] if top.is_file else [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file]
    root = root.rpartition("/")[0] if top.is_file else root
    rows = [(i.path[len(root.rstrip("/")) + 1 :], i.size) for i in found]
    return spark.createDataFrame(rows, "name string, length bigint").repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))), "name")


def ranges(stream) -> Iterator[bytes]:
    """A stream's content in pieces of a MiB."""
    while data := stream.read(RANGE):
        yield data


def digest(stream) -> str:
    h = hashlib.sha256()
    for data in ranges(stream):
        h.update(data)
    return h.hexdigest()


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """name, length and SHA-256 of all files below a folder, or of the one file it names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        root = root.rpartition("/")[0] if store.get_file_info(root).is_file else root
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as f:
                    out.append(digest(f))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["name", "length", "sha256"])

    return listing(spark, folder).mapInArrow(work, "name string, length bigint, sha256 string")


def verified_copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Files of a folder copied below another one, then read again: name, length, both hashes, whether they agree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, root), (there, end) = _store(source), _store(target)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                there.create_dir(f"{end}/{name}".rsplit("/", 1)[0], recursive=True)
                h = hashlib.sha256()
                with here.open_input_stream(f"{root}/{name}") as f, there.open_output_stream(f"{end}/{name}") as out:
                    for data in ranges(f):
                        h.update(data)
                        out.write(data)
                with there.open_input_stream(f"{end}/{name}") as back:
                    rows.append((h.hexdigest(), digest(back)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], pa.string()) for k in (0, 1))], ["name", "length", "sha256", "copied_sha256"])

    return listing(spark, source).mapInArrow(work, "name string, length bigint, sha256 string, copied_sha256 string").withColumn("agree", F.col("sha256") == F.col("copied_sha256"))
