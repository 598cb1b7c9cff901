"""Finding datasets on a file system, and loading one whether it is a file or a directory of parts."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.sources.files import FORMATS, format_of, read_csv_groups, read_json, read_parquet


class DatasetError(Exception):
    """The dataset cannot be read; the message says why."""


@dataclass(frozen=True)
class DatasetFile:
    """One dataset found on disk: a file, or a directory of part files."""

    path: str
    format: str
    size_bytes: int
    parts: tuple[str, ...]


def _listing(spark: SparkSession, path: str) -> tuple[object, object]:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def find_dataset(spark: SparkSession, path: str) -> DatasetFile:
    """The data files at a path; marker files such as ``_SUCCESS`` are ignored."""
    fs, location = _listing(spark, path)
    if not fs.exists(location):
        raise DatasetError(f"no output at {path}")
    status = fs.getFileStatus(location)
    if status.isFile():
        return DatasetFile(path, format_of(path), status.getLen(), (path,))
    parts, size = [], 0
    files = fs.listFiles(location, True)
    while files.hasNext():
        entry = files.next()
        name = entry.getPath().getName()
        if not _hidden(name) and format_of(name) != "unknown":
            parts.append((entry.getPath().toString(), format_of(name)))
            size += entry.getLen()
    formats = {f for _, f in parts}
    if not parts:
        raise DatasetError(f"{path} holds none of {', '.join(sorted(FORMATS))}")
    if len(formats) > 1:
        raise DatasetError(f"{path} mixes formats: {sorted(formats)}")
    return DatasetFile(path, formats.pop(), size, tuple(sorted(p for p, _ in parts)))


def load_dataset(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """One file or a directory of parts as one table. A missing path raises :class:`DatasetError`."""
    return load_found(spark, find_dataset(spark, path), schema)


def load_found(
    spark: SparkSession, dataset: DatasetFile, schema: T.StructType | str | None = None
) -> DataFrame:
    """Part files are put together by column name, as a list of frames is in pandas."""
    paths = list(dataset.parts)
    if dataset.format == "parquet":
        return read_parquet(spark, paths, merge=len(paths) > 1)
    if dataset.format == "json":
        return read_json(spark, paths, schema)
    if dataset.format == "csv":
        return read_csv_groups(spark, csv_groups(spark, paths), schema)
    raise DatasetError(f"cannot read {dataset.path}")


def csv_groups(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], str]]:
    """The paths by header and separator; a single file needs no look at its header."""
    by_suffix = {p: FORMATS["." + p.rsplit(".", 1)[-1].lower()][1] for p in paths}
    if len(paths) == 1:
        return [(paths, by_suffix[paths[0]])]
    first = spark.read.text(paths).filter(F.col("_metadata.file_block_start") == 0)
    first = first.select(F.col("_metadata.file_path").alias("p"), "value", F.monotonically_increasing_id().alias("i"))
    headers = first.groupBy("p").agg(F.min_by("value", "i").alias("header"))
    known = {_plain(r["p"]): r["header"] for r in headers.toLocalIterator()}
    groups: dict[tuple[str, str | None], list[str]] = {}
    for path in paths:
        if _plain(path) in known:  # a file without a line has no columns either
            groups.setdefault((by_suffix[path], known[_plain(path)]), []).append(path)
    return [(members, sep) for (sep, _), members in groups.items()] or [(paths, by_suffix[paths[0]])]


def _plain(path: str) -> str:
    """Without the ways to write a local scheme, and decoded."""
    return unquote(path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path)


def scan_directory(spark: SparkSession, path: str) -> list[DatasetFile]:
    """Every readable dataset directly in a directory, by name; other files are skipped."""
    fs, location = _listing(spark, path)
    if not fs.exists(location) or not fs.getFileStatus(location).isDirectory():
        return []
    found = []
    for entry in fs.listStatus(location):
        name = entry.getPath().getName()
        if _hidden(name):
            continue
        if entry.isFile() and format_of(name) == "unknown":
            continue
        try:
            found.append(find_dataset(spark, entry.getPath().toString()))
        except DatasetError:
            continue
    return sorted(found, key=lambda d: d.path)
