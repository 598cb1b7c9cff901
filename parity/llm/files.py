"""Files beside Spark's own readers, on the shared folder, by URI."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import SparkSession

from parity.session import shared_dir


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares, as a URI."""
    base = shared_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, attempt: str, write) -> None:
    """Let ``write(stream)`` fill a file of this attempt and then put it in place; a repeated task replaces it by
    the same bytes, a lost one leaves at most an unnamed part."""
    system, path = opened(uri)
    system.create_dir(str(PurePosixPath(path).parent), recursive=True)
    part = f"{path}.{attempt}"
    with system.open_output_stream(part) as stream:
        write(stream)
    system.move(part, path)


def read_parquet(uri: str):
    """A table of bounded size that Spark wrote, whole, inside a task."""
    import pyarrow.dataset as ds

    system, path = opened(uri)
    return ds.dataset(path, filesystem=system, format="parquet").to_table()


def parquet_batches(uri: str, rows: int):
    """A table that Spark wrote, at most so many rows at a time, inside a task."""
    import pyarrow.dataset as ds

    system, path = opened(uri)
    for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=rows):
        if batch.num_rows:
            yield batch
