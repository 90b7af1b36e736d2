"""Files that land in a folder, as a stream that takes no more than some of them a batch.

A batch is a grant: a small manifest of file names, numbered, in the ``ledger`` folder. The stream's offset is the number of the last grant, so the files of
a batch are the same ones whenever it is run again, and a query that starts anew from its checkpoint goes on where it was. A new grant takes
the next ``max_files`` files in order of time and name. A file's grant waits ``settle_seconds`` after its time, so that none with an earlier time
is still to come. Names alone pass through the driver; tasks read the files, ``files_per_task`` each.

Both folders are paths or URIs that Arrow's file systems know, shared by driver and executors. Files appear whole (by a rename) and don't change.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, content string"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, folder: str, files: list) -> None:
        self.folder, self.files = folder, files


class LandedReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.ledger = options["path"], options["ledger"]
        self.most, self.per_task, self.settle = int(options.get("max_files", 100)), int(options.get("files_per_task", 8)), float(options.get("settle_seconds", 1))
        if self.most < 1 or self.per_task < 1:
            raise ValueError("max_files and files_per_task must be 1 or more")

    def _granted(self) -> int:
        system, at = _at(self.ledger)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return max((int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json")), default=0)

    def _grant(self, number: int) -> list:
        system, at = _at(self.ledger)
        with system.open_input_stream(f"{at}/{number:012d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"grant": 0}

    def latestOffset(self) -> dict:
        last = self._granted()
        mark = tuple(self._grant(last)[-1]) if last else (0, "")
        system, at = _at(self.folder)
        files = [f for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        until = time.time_ns() - int(self.settle * 1e9)
        new = sorted((f.mtime_ns, f.base_name) for f in files if mark < (f.mtime_ns, f.base_name) and f.mtime_ns <= until)[: self.most]
        if new:
            system, at = _at(self.ledger)
            system.create_dir(at, recursive=True)
            with system.open_output_stream(f"{at}/_{last + 1}") as out:
                out.write(json.dumps(new).encode())
            system.move(f"{at}/_{last + 1}", f"{at}/{last + 1:012d}.json")
        return {"grant": last + bool(new)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files = [f for k in range(start["grant"] + 1, end["grant"] + 1) for f in self._grant(k)]
        return [_Files(self.folder, files[a : a + self.per_task]) for a in range(0, len(files), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, at = _at(partition.folder)
        for mtime, name in partition.files:
            with system.open_input_stream(f"{at}/{name}") as f:
                content = f.read().decode("utf-8", "replace")
            yield pa.record_batch([pa.array([name]), pa.array([mtime // 1000], pa.timestamp("us", "UTC")), pa.array([content])], names=["path", "modified", "content"])

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    """``spark.readStream.format("landed").options(path=..., ledger=..., max_files=...)``, once ``spark.dataSource.register(Landed)`` was called."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LandedReader:
        return LandedReader(dict(self.options))
