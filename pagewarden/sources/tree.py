"""A data source that lists a tree of folders, and reads small files whole, in the tasks: ``spark.read.format("tree")``.

Spark's own file sources list on the driver and leave out names that begin with ``_`` or ``.``, which is what rule files are called. Here the driver lists one level below the root; its folders are dealt to partitions, and each task
walks its own. Options: path (a local path or a URI that pyarrow.fs knows), names (a pattern such as ``_redirects`` or ``*.html``; several parted by commas), exclude (prefixes of paths below the root, parted by commas),
text (true: with the files' text, for small files), partitions (of folders, at most; 64 if not given).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, bytes bigint"
#: Rows, and bytes of text, that a task hands over at once.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def _open(root: str):
    """The file system of a root, and its path there."""
    from pyarrow import fs

    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else root
    return fs.FileSystem.from_uri(root)


@dataclass
class Folders(InputPartition):
    """Folders below the root, each walked whole, and files that lie in the root itself (paths, bytes)."""

    folders: list[str]
    files: list[tuple[str, int]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], text: bool):
        self.root, self.text = options["path"].rstrip("/") or "/", text
        listed = lambda name: tuple(x.strip() for x in options.get(name, "").split(",") if x.strip())
        self.names, self.exclude = listed("names"), listed("exclude")
        self.most = int(options.get("partitions", "64"))

    def _relative(self, base: str, path: str) -> str:
        return path[len(base.rstrip("/")) + 1 :]

    def _wanted(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return not path.startswith(self.exclude) and (not self.names or any(fnmatchcase(name, x) for x in self.names))

    def _base(self):
        """The file system, and the root's path; of a root that is one file the folder, and the file."""
        from pyarrow import fs

        system, base = _open(self.root)
        alone = system.get_file_info(base)
        if alone.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        return (system, base.rpartition("/")[0] or "/", alone) if alone.type == fs.FileType.File else (system, base, None)

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        system, base, alone = self._base()
        if alone:
            return [Folders([], [(base_name, alone.size)] if self._wanted(base_name := alone.path.rpartition("/")[2]) else [])]
        level = system.get_file_info(fs.FileSelector(base))
        folders = sorted(p for x in level if x.type == fs.FileType.Directory and not f"{(p := self._relative(base, x.path))}/".startswith(self.exclude or "\0"))
        files = [(p, x.size) for x in level if x.type == fs.FileType.File and self._wanted(p := self._relative(base, x.path))]
        n = max(1, min(self.most, len(folders)))
        return [Folders(folders[k::n], files if k == 0 else []) for k in range(n)]

    def _found(self, part: Folders) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        system, base, _ = self._base()
        yield from part.files
        waiting = list(reversed(part.folders))
        while waiting:  # a folder at a time, so that no listing of a whole tree is held
            for x in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{waiting.pop()}")):
                path = self._relative(base, x.path)
                if x.type == fs.FileType.Directory and not f"{path}/".startswith(self.exclude or "\0"):
                    waiting.append(path)
                elif x.type == fs.FileType.File and self._wanted(path):
                    yield path, x.size

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, base, _ = self._base()
        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), *[("value", pa.string())] * self.text])
        rows, size = [], 0
        for path, n in self._found(partition):  # type: ignore[arg-type]
            row = [path, n]
            if self.text:
                with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    row.append(f.read().decode("utf-8", "replace"))
            rows.append(row)
            size += n if self.text else 0
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    @property
    def _text(self) -> bool:
        return self.options.get("text", "false").lower() == "true"

    def schema(self) -> str:
        return SCHEMA + (", value string" if self._text else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(dict(self.options), self._text)


def read_tree(spark: SparkSession, root: str, names: str = "", exclude: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """path (below ``root``), bytes and, with ``text``, value of the files below ``root``. A folder without files gives no rows."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("names", names).option("exclude", ",".join(exclude)).option("text", str(text).lower()).load(root)
