"""A data source for Arrow IPC files, which Spark has none for: read in parts, filtered by statistics, streamed, and written with a commit.

    spark.dataSource.register(ArrowFiles)
    df.write.format("arrow_files").mode("append").save(folder)
    spark.read.format("arrow_files").load(folder)

A folder holds files of record batches and, for each commit, a manifest that lists its files with the place, rows and least and greatest values of every batch.
Only what a manifest lists exists for readers, and a manifest is one small file written at the end: tasks that fail, are tried again or come late leave files that no reader sees, and an
aborted write takes its folder away. A batch of rows is one partition of a read. With the option pushdown=true, which needs
spark.sql.python.filterPushdown.enabled, filters skip the batches that can't hold a match and are then applied by Spark to the rest. A stream's offset is the number of commits read; a stream that
writes names its manifests by batch, so a batch that comes again after a restart is not written twice.

Paths are those that Arrow's file systems know. Commits to one folder come one after another. Batches without rows are not written; a folder without commits is an empty
table if the schema is given, else an error. Statistics leave out nulls; a batch of a column's nulls only matches no comparison.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Types whose least and greatest values are kept: JSON holds them exactly
KEPT = (pa.types.is_integer, pa.types.is_floating, pa.types.is_string)
ROWS = 100_000


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[str]:
    """Commits in their order."""
    fs, root = _files(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json"))


def _read(path: str, name: str) -> dict:
    fs, _ = _files(path)
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


def _statistics(batch: pa.RecordBatch) -> dict[str, list]:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if any(k(column.type) for k in KEPT):
            ends = pc.min_max(column).as_py()
            if ends["min"] is None:
                out[name] = []
            elif not (pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py()):
                out[name] = [ends["min"], ends["max"]]
    return out


@dataclass
class Part(InputPartition):
    file: str
    batch: int


@dataclass
class Written(WriterCommitMessage):
    files: list
    made: list


def may_hold(statistics: dict, filters: list) -> bool:
    """Whether a batch can hold a row for which all filters hold."""
    for f in filters:
        ends = statistics.get(f.attribute[0])
        if ends is None:
            continue
        if not ends:
            return False
        low, high = ends
        if isinstance(f, EqualTo) and not low <= f.value <= high or isinstance(f, In) and not any(low <= v <= high for v in f.value if v is not None):
            return False
        if isinstance(f, (LessThan, LessThanOrEqual)) and (low > f.value or low == f.value and isinstance(f, LessThan)):
            return False
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and (high < f.value or high == f.value and isinstance(f, GreaterThan)):
            return False
    return True


def _parts(path: str, manifests: list[str], filters: list) -> list[Part]:
    _, root = _files(path)
    out = []
    for m in manifests:
        for file in _read(path, m)["files"]:
            out += [Part(f"{root}/{file['name']}", i) for i, s in enumerate(file["batches"]) if may_hold(s, filters)]
    return out


def _rows(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    fs, _ = _files(path)
    with fs.open_input_file(part.file) as f, pa.ipc.open_file(f) as file:
        yield file.get_batch(part.batch)


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def partitions(self):
        return _parts(self.path, _manifests(self.path), self.filters) or [Part("", -1)]

    def read(self, partition):
        yield from _rows(self.path, partition) if partition.file else ()


class FilteringReader(ArrowReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and len(f.attribute) == 1:
                self.filters.append(f)
            yield f  # Spark checks the rows of the batches that are left


class ArrowStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(_manifests(self.path))}

    def partitions(self, start, end):
        return _parts(self.path, _manifests(self.path)[start["commits"] : end["commits"]], [])

    def read(self, partition):
        return _rows(self.path, partition)

    def commit(self, end):
        pass


def _write(path: str, part: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """A task's rows as one file in a folder of its write; a task that fails takes it away again."""
    fs, root = _files(path)
    fs.create_dir(f"{root}/{part}", recursive=True)
    own = (b for b in batches if b.num_rows)
    first = next(own, None)
    if first is None:
        return Written([], [])
    name, statistics = f"{part}/{uuid.uuid4().hex}.arrow", []
    try:
        with fs.open_output_stream(f"{root}/{name}") as f, pa.ipc.new_file(f, first.schema) as out:
            for b in chain([first], own):
                for at in range(0, b.num_rows, ROWS):
                    out.write_batch(part := b.slice(at, ROWS))
                    statistics.append(_statistics(part))
    except BaseException:
        fs.delete_file(f"{root}/{name}")
        raise
    return Written([{"name": name, "batches": statistics}], [name])


def _commit(path: str, messages: list, name: str, replace: bool = False) -> None:
    fs, root = _files(path)
    fs.create_dir(f"{root}/_commits", recursive=True)
    before = _manifests(path) if replace else []
    target = f"{root}/_commits/{name}.json"
    if fs.get_file_info(target).type != pyarrow.fs.FileType.NotFound:
        return _remove(path, messages)  # the batch had been committed
    with fs.open_output_stream(f"{target}.new") as f:
        f.write(json.dumps({"files": [x for m in messages if m for x in m.files]}).encode())
    fs.move(f"{target}.new", target)
    for m in before:
        fs.delete_file(m)


def _remove(path: str, messages: list) -> None:
    fs, root = _files(path)
    for name in (n for m in messages if m for n in m.made):
        fs.delete_file(f"{root}/{name}")


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.part = path, overwrite, f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator):
        return _write(self.path, self.part, iterator)

    def commit(self, messages):
        _commit(self.path, messages, self.part, self.overwrite)

    def abort(self, messages):
        fs, root = _files(self.path)
        if fs.get_file_info(f"{root}/{self.part}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.part}")  # also what tasks left that told nothing


class ArrowStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, query: str):
        self.path, self.query = path, query

    def write(self, iterator):
        return _write(self.path, self.query, iterator)

    def commit(self, messages, batchId):
        _commit(self.path, messages, f"{self.query}-{batchId:020d}")

    def abort(self, messages, batchId):
        _remove(self.path, messages)


class ArrowFiles(DataSource):
    """Options: path; pushdown; query, the name of a stream that writes (one for each checkpoint)."""

    @classmethod
    def name(cls):
        return "arrow_files"

    def schema(self):
        path = self.options["path"]
        for m in _manifests(path):
            for file in _read(path, m)["files"]:
                fs, root = _files(path)
                with fs.open_input_file(f"{root}/{file['name']}") as f, pa.ipc.open_file(f) as opened:
                    return from_arrow_schema(opened.schema, prefer_timestamp_ntz=True)
        raise ValueError(f"{path} has no rows to take a schema from")

    def reader(self, schema: StructType):
        return (FilteringReader if self.options.get("pushdown") == "true" else ArrowReader)(self.options["path"])

    def streamReader(self, schema: StructType):
        return ArrowStreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool):
        return ArrowWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool):
        return ArrowStreamWriter(self.options["path"], self.options["query"])
