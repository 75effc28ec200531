"""A data source that writes framed messages as files: each message behind its size, 4 bytes big-endian or a varint.

    spark.dataSource.register(FramedSource)
    df.write.format("framed").option("path", "/data/projects").mode("overwrite").save()

Tasks write below <path>/_temporary/<job>; only when all have succeeded are the files renamed to part-*.bin and their sizes noted in
<path>/_SIZES, so that a failed task or job leaves nothing that a reader sees (a task that is killed may leave a file below _temporary). Files are written where pyarrow's file systems write.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


FRAMES = {"int32": lambda n: struct.pack(">i", n), "varint": _varint}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    partition: int
    bytes: int
    messages: int


class FramedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "message binary"

    def writer(self, schema: StructType, overwrite: bool) -> FramedWriter:
        if "message" not in schema.fieldNames():
            raise ValueError("framed files are written from a column message")
        return FramedWriter(self.options["path"], self.options.get("framing", "int32"), overwrite)


class FramedWriter(DataSourceArrowWriter):
    """Null messages are left out. mode("append") adds files, mode("overwrite") replaces them."""

    def __init__(self, path: str, framing: str, overwrite: bool):
        if framing not in FRAMES:
            raise ValueError(f"no such framing: {framing}")
        self.path, self.framing, self.overwrite, self.job = path, framing, overwrite, uuid.uuid4().hex

    def _temporary(self) -> tuple[fs.FileSystem, str, str]:
        system, root = file_system(self.path)
        return system, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, _, folder = self._temporary()
        partition, total, messages, out = TaskContext.get().partitionId(), 0, 0, None
        name = f"{folder}/{partition}-{uuid.uuid4().hex}"
        frame = FRAMES[self.framing]
        try:
            for batch in iterator:
                for message in batch.column(batch.schema.get_field_index("message")):
                    if message.is_valid:
                        if out is None:
                            system.create_dir(folder)
                            out = system.open_output_stream(name)
                        body = message.as_buffer()
                        head = frame(body.size)
                        out.write(head)
                        out.write(body)
                        total, messages = total + len(head) + body.size, messages + 1
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(name)
            raise
        if out is not None:
            out.close()
        return Written(name if out is not None else None, partition, total, messages)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, _ = self._temporary()
        system.create_dir(root)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        sizes = {"bytes": 0, "messages": 0}
        if not self.overwrite:
            sizes = read_sizes(self.path) or sizes
        else:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("part-") or info.base_name == "_SIZES":
                    system.delete_file(info.path)
        for m in parts:
            if m.file:
                system.move(m.file, f"{root}/part-{m.partition:05d}-{self.job}.bin")
        sizes = {"bytes": sizes["bytes"] + sum(m.bytes for m in parts), "messages": sizes["messages"] + sum(m.messages for m in parts)}
        with system.open_output_stream(f"{root}/_SIZES") as out:
            out.write(json.dumps(sizes).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root, folder = self._temporary()
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)
        above = f"{root}/_temporary"
        if system.get_file_info(above).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


def read_sizes(path: str) -> dict[str, int] | None:
    """The bytes and messages that have been written at path, frames included."""
    system, root = file_system(path)
    if system.get_file_info(f"{root}/_SIZES").type == fs.FileType.NotFound:
        return None
    with system.open_input_file(f"{root}/_SIZES") as file:
        return json.loads(file.read())


def write_framed(df: DataFrame, path: str, framing: str = "int32", mode: str = "overwrite") -> dict[str, int]:
    """Write column message of df as framed files at path; the bytes and messages there are now."""
    df.sparkSession.dataSource.register(FramedSource)
    df.select("message").write.format("framed").option("framing", framing).option("path", path).mode(mode).save()
    return read_sizes(path)
