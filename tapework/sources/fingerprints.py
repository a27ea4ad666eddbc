"""A data source of file fingerprints that reads only the ends of files, of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MIB = 1 << 20
#: Files of a partition: each costs two short reads, whatever its size.
GROUP = 64


@dataclass
class Files(InputPartition):
    """A group of files, as paths of the file system that the folder's URI names."""

    paths: list[str]


def _digest(system: object, path: str) -> tuple[int | None, str]:
    """Size, and sha256 of the size as text, the first MiB, and the last MiB if there is more than one. (None, "") for what is gone."""
    try:
        with system.open_input_file(path) as file:
            size = file.size()
            digest = hashlib.sha256(str(size).encode("ascii"))
            digest.update(file.read(MIB))
            if size > MIB:
                file.seek(size - MIB)
                digest.update(file.read(MIB))
            return size, digest.hexdigest()
    except FileNotFoundError:
        return None, ""


class _Reader(DataSourceReader):
    def __init__(self, uri: str, group: int):
        self.uri, self.group = uri, group

    def _system(self) -> tuple[object, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(i.path for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        return [Files(paths[at : at + self.group]) for at in range(0, len(paths), self.group)]

    def read(self, partition: Files) -> Iterator[tuple[str, int | None, str]]:
        system, _ = self._system()
        for path in getattr(partition, "paths", []):
            yield path, *_digest(system, path)


class FileFingerprints(DataSource):
    """Format "file_fingerprints". path: a file or folder, as a path or URI that Arrow's file systems open; files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "file_fingerprints"

    def schema(self) -> str:
        return "file string, size long, fingerprint string"

    def reader(self, schema: object) -> DataSourceReader:
        uri = self.options["path"]
        return _Reader(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}", int(self.options.get("files_per_partition", GROUP)))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """file, size and fingerprint of the files at or below path. Of each at most two MiB are read; a file that goes meanwhile has an empty fingerprint."""
    spark.dataSource.register(FileFingerprints)
    return spark.read.format("file_fingerprints").load(path)
