"""Result tables that are there whole or not at all: a data source with its own commit.

``df.write.format("committed").option("path", p).mode("overwrite" or "append").save()``
writes a file of JSON lines in each task, under a name of that attempt's own.  Only
when all tasks are done does the driver put one new manifest in place, which names the
files of the attempts that counted.  Readers take the latest manifest, so a task or a
commit that dies leaves the old rows standing; what it left behind is removed by the
abort or by ``clean``.  A manifest is written under a name of its own and moved there,
which needs no overwriting rename of the store.  One writer at a time is assumed.

Paths are those of the store that executors share; ``s3a://`` is read as ``s3://``.
``read`` gives the rows back by Spark's JSON reader, ``results`` describes them.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_MANIFESTS, _DATA = "_manifests", "data"


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    system, inner = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, inner.rstrip("/")


def _plain(value):
    """What JSON has no form for, as Spark's JSON reader takes it."""
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    raise TypeError(f"no JSON for {type(value).__name__}")


def _mapped(value, kind: pa.DataType):
    """Arrow gives maps as lists of pairs; JSON has objects."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return {str(k): _mapped(v, kind.item_type) for k, v in value}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_mapped(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind):
        return {f.name: _mapped(value[f.name], f.type) for f in kind}
    return value


def _has_map(kind: pa.DataType) -> bool:
    return pa.types.is_map(kind) or any(_has_map(kind.field(i).type) for i in range(kind.num_fields))


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    file: str
    rows: int
    size: int


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.note = options.get("note", "")
        self.version = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = store_of(self.path)
        name = f"{self.version}-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}.json"
        system.create_dir(f"{root}/{_DATA}", recursive=True)
        rows = size = 0
        with system.open_output_stream(f"{root}/{_DATA}/{name}") as out:
            for batch in iterator:
                maps = [f for f in batch.schema if _has_map(f.type)]
                for row in batch.to_pylist():
                    for f in maps:
                        row[f.name] = _mapped(row[f.name], f.type)
                    line = json.dumps(row, ensure_ascii=False, default=_plain).encode() + b"\n"
                    out.write(line)
                    rows, size = rows + 1, size + len(line)
        return Written(name, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store_of(self.path)
        told = [m for m in messages if m is not None]
        before = None if self.overwrite else _latest(system, root)
        value = {
            "version": self.version,
            "note": self.note,
            "files": [*(before["files"] if before else []), *({"file": m.file, "rows": m.rows, "size": m.size} for m in told)],
        }
        _put(system, root, value)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing was named by a manifest: this version's files go."""
        system, root = store_of(self.path)
        for info in _listed(system, f"{root}/{_DATA}"):
            if info.base_name.startswith(self.version):
                system.delete_file(info.path)


class Committed(DataSource):
    """The data source; reading goes by ``read``."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: T.StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options, overwrite)


def _listed(system: pyarrow.fs.FileSystem, folder: str) -> list[pyarrow.fs.FileInfo]:
    found = system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == pyarrow.fs.FileType.File), key=lambda f: f.base_name)


def _manifests(system, root: str) -> list[pyarrow.fs.FileInfo]:
    return [f for f in _listed(system, f"{root}/{_MANIFESTS}") if f.base_name.endswith(".json")]


def _latest(system, root: str) -> dict | None:
    names = _manifests(system, root)
    if not names:
        return None
    with system.open_input_stream(names[-1].path) as f:
        return json.loads(f.read())


def _put(system, root: str, value: dict) -> None:
    """One more manifest, after all that there are."""
    names = _manifests(system, root)
    number = int(names[-1].base_name.split("-", 1)[0]) + 1 if names else 0
    target = f"{root}/{_MANIFESTS}/{number:012d}-{value['version']}.json"
    system.create_dir(f"{root}/{_MANIFESTS}", recursive=True)
    with system.open_output_stream(f"{target}.part") as out:
        out.write(json.dumps(value).encode())
    system.move(f"{target}.part", target)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)


def write(df: DataFrame, path: str, mode: str = "overwrite", note: str = "") -> None:
    """Put ``df`` in the place of what is at ``path``, or add it (mode "append")."""
    register(df.sparkSession)
    df.write.format("committed").option("path", path).option("note", note).mode(mode).save()


def state(path: str) -> dict | None:
    """The latest manifest: version, note and files with their rows; None if there is none."""
    return _latest(*store_of(path))


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The committed rows; none where nothing was committed."""
    now = state(path)
    files = [f"{path.rstrip('/')}/{_DATA}/{f['file']}" for f in now["files"] if f["rows"]] if now else []
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(files)


def clean(path: str, keep: int = 1) -> int:
    """Drop manifests but the last ``keep`` and the files that none of those names; the
    number of files dropped. Not while a writer is at work."""
    system, root = store_of(path)
    names = _manifests(system, root)
    held = set()
    for info in names[-keep:]:
        with system.open_input_stream(info.path) as f:
            held |= {x["file"] for x in json.loads(f.read())["files"]}
    for info in names[:-keep]:
        system.delete_file(info.path)
    gone = [f for f in _listed(system, f"{root}/{_DATA}") if f.base_name not in held]
    for info in gone:
        system.delete_file(info.path)
    return len(gone)
