"""Single files as a Spark sink: rows become files, or copies of files, all of them or none.

Tasks write into a staging folder beside the targets, each attempt into a folder of its own, and report that folder. When
all tasks have ended, the driver moves the files of the reported attempts to their targets; attempts that failed, were
lost or ran twice are never reported, and go with the staging folder. Paths may be of any file system that Arrow knows
(`file:`, `s3://`, `hdfs://`, `gs://`) and that all executors reach.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "annograph_files"
MOVERS = 16
_PIECE = 8 << 20


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it. Paths are plain, not percent-encoded."""
    remote = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]*)(/.*)?$", path)
    if remote and remote[1] != "file":
        system, base = fs.FileSystem.from_uri(f"{remote[1]}://{remote[2]}/")
        return system, base.rstrip("/") + (remote[3] or "")
    plain = path.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + plain.lstrip("/") if plain.startswith("/") else plain


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """`body` given: its text is written. `src` given: that file is copied. A target that exists stays unless `overwrite`."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        self.name, self.body, self.src = options["name"], options.get("body"), options.get("src")
        self.overwrite, self.indent = options.get("overwrite") == "true", options.get("indent")

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        for batch in batches:
            yield from zip(batch.column(self.name), batch.column(self.body or self.src))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        system, base = locate(folder)
        system.create_dir(base, recursive=True)
        targets = []
        for name, value in self._rows(iterator):
            staged = f"{base}/{len(targets)}"
            if self.body:
                text = value.as_py()
                if self.indent:
                    text = json.dumps(json.loads(text), ensure_ascii=False, indent=int(self.indent))
                with system.open_output_stream(staged) as out:
                    out.write(text.encode())
            else:
                source, path = locate(value.as_py())
                with source.open_input_stream(path) as read, system.open_output_stream(staged) as out:
                    while piece := read.read(_PIECE):
                        out.write(piece)
            target = name.as_py()
            targets.append(target if target.startswith("/") or ":" in target.split("/")[0] else f"{self.root}/{target}")
        with system.open_output_stream(f"{base}/targets") as out:
            out.write(json.dumps(targets).encode())
        return Staged(folder, len(targets))

    def commit(self, messages: list[Staged | None]) -> None:
        def publish(staged: str, target: str) -> None:
            system, path = locate(target)
            if self.overwrite or system.get_file_info(path).type == fs.FileType.NotFound:
                system.move(staged, path)

        with ThreadPoolExecutor(MOVERS) as movers:
            for message in filter(None, messages):
                system, base = locate(message.folder)
                with system.open_input_stream(f"{base}/targets") as read:
                    targets = json.loads(read.read())
                for parent in {posixpath.dirname(t) for t in targets}:
                    where, path = locate(parent)
                    where.create_dir(path, recursive=True)
                list(movers.map(publish, [f"{base}/{n}" for n in range(len(targets))], targets))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, base = locate(self.staging)
        if system.get_file_info(base).type != fs.FileType.NotFound:
            system.delete_dir(base)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def _save(df: DataFrame, **options: str) -> None:
    df.sparkSession.dataSource.register(FileSink)
    df.write.format(FORMAT).mode("append").options(**options).save()


def write_files(df: DataFrame, out: str, name: str, body: str, indent: int | None = None) -> None:
    """One file of UTF-8 text for each row; relative names are below `out`. Names must differ. With `indent`, JSON is laid out."""
    given = {} if indent is None else {"indent": str(indent)}
    _save(df.select(name, body), path=out, name=name, body=body, overwrite="true", **given)


def copy(manifest: DataFrame, src: str = "src", dst: str = "dst", overwrite: bool = False) -> None:
    """Copies of the files named by a manifest of full paths, all or none. Existing targets stay unless `overwrite`."""
    rows = manifest.select(src, dst).dropna()
    ends = rows.agg(F.min(dst), F.max(dst)).first()
    if ends[0] is None:
        return
    common = posixpath.commonprefix(list(ends))  # what the first and the last name share, all share
    _save(rows, path=posixpath.dirname(common) or "/", name=dst, src=src, overwrite=str(overwrite).lower())
