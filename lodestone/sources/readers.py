"""Readers of the corpus's files, all with schemas given."""

from __future__ import annotations

import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lodestone.operators.lineage import counted, materialise
from lodestone.sources import seeks
from lodestone.sources.framed import file_system


def frames(data: bytes, framing: str = "int32") -> Iterator[bytes]:
    """Messages of a stream: each behind its size, 4 bytes big-endian or a varint. A stream that ends within a
    message is an error, at a boundary it has ended."""
    at = 0
    while at < len(data):
        if framing == "int32":
            if at + 4 > len(data):
                raise OSError("stream ends within a size")
            (size,) = struct.unpack_from(">i", data, at)
            at += 4
        else:
            size = shift = 0
            while True:
                if at >= len(data):
                    raise OSError("stream ends within a size")
                size |= (data[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if data[at - 1] < 128:
                    break
        if size < 0 or at + size > len(data):
            raise OSError("stream ends within a message")
        yield data[at : at + size]
        at += size


def unframed(streams: DataFrame, framing: str = "int32") -> DataFrame:
    """streams: content, and path if it is known. (path, ordinal, message) of the messages in each."""
    if "path" not in streams.columns:
        streams = streams.withColumn("path", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                held, size = [], 0
                for i, m in enumerate(frames(content, framing)):
                    held.append((name, i, m))
                    size += len(m)
                    if size > 16 << 20:
                        yield pd.DataFrame(held, columns=["path", "ordinal", "message"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["path", "ordinal", "message"])

    return streams.select("path", "content").mapInPandas(run, "path string, ordinal long, message binary")


def typed_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True) -> DataFrame:
    """RFC 4180; NA and empty fields are null."""
    df = spark.read.csv(path, schema=schema, header=header, quote='"', escape='"', multiLine=True, nullValue="NA", enforceSchema=True)
    return df.select(*(F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema))


def read_export(spark: SparkSession, root: str, name: str, schema: StructType | str, outcome: str = "rows") -> DataFrame:
    """What writers.write_exports() wrote of one export, rows or problems."""
    return typed_csv(spark, f"{root}/export={name}/outcome={outcome}", schema, header=False)


# a quoted field with its escapes, or a bare one; and what ends it
_FIELD = re.compile(r'(?:"((?:\\.|[^"\\\n])*)"?|([^,\n]*))(,|\n|\Z)', re.S)
_DECODED = {"b": "\b", "n": "\n", "r": "\r", "t": "\t", "z": "\x1a"}


def backslash_rows(text: str, decode: bool = False) -> Iterator[list[str]]:
    """Rows of a text in one scan: within quotes a backslash makes what follows, a line end too, part of the field, decode: `\\b \\n \\r \\t \\z`
    what they stand for. A quoted field that a line leaves open ends with it."""
    one = (lambda m: _DECODED.get(m[1], m[1])) if decode else (lambda m: m[1])
    at, row = 0, []
    while at < len(text):
        m = _FIELD.match(text, at)
        if not m:
            raise ValueError(f"text between a field and its end at {at}")
        row.append(m[2] if m[1] is None else re.sub(r"(?s)\\(.)", one, m[1]))
        if m[3] != ",":
            yield row
            row = []
        elif m.end() == len(text):
            row.append("")
        at = m.end()
    if row:
        yield row


def backslash_csv(spark: SparkSession, path: str, schema: StructType | str, decode: bool = False, split: int = seeks.SPLIT) -> DataFrame:
    """Files in the dialect of backslash_rows(), read in pieces of `split` bytes. Fields that aren't of their type, and
    missing ones, are null."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rows = seeks.quoted_records(spark, path, partial(backslash_rows, decode=decode), split)
    return rows.select(*(F.get("row", i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of each line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def project_csvs(spark: SparkSession, root: str, rel_path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """Union of <root>/<project>/<rel_path> of all projects that have it, project_id first: the
    directory's name, whatever the file says."""
    df = typed_csv(spark, f"{root}/*/{rel_path}", schema, header)
    depth = rel_path.count("/") + 2
    project = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -depth)
    return df.select(F.url_decode(project).alias("project_id"), *(c for c in df.columns if c != "project_id"))


def compiled_documents(spark: SparkSession, root: str, suffix: str = ".semanticdb", skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, entry, content) of the files with the suffix below root, and of those in jars there and in the jars and folders that the manifests
    of these name in Class-Path, from wherever, entries by lower-case name. Paths with a skipped directory name are left out.

    Of a jar the directory and the entries wanted are read. Named jars are followed a round at a time, until none names one that hasn't been read."""
    parts = F.split("path", "/")
    files = seeks.files(spark, root, recursive=True).select("path").where((F.col("path").endswith(suffix) | F.col("path").endswith(".jar")) & ~F.arrays_overlap(parts, F.array(*map(F.lit, skip or ("\0",)))))
    schema = "path string, entry string, content binary, named array<string>"
    run = partial(_documents, suffix=suffix)
    found = rows = materialise(files.mapInArrow(run, schema))
    while True:
        seen = found.select("path").distinct()
        new, left = counted(rows.select(F.explode("named").alias("path")).distinct().join(seen, "path", "left_anti"), F.lit(True))
        if not left:
            return found.where("named IS NULL").select("path", "entry", "content")
        rows = materialise(new.mapInArrow(run, schema))
        found = found.unionByName(rows)


def _documents(batches: Iterator[pa.RecordBatch], suffix: str) -> Iterator[pa.RecordBatch]:
    def row(path, entry=None, content=None, named=None):
        return pa.RecordBatch.from_pylist([{"path": path, "entry": entry, "content": content, "named": named}], pa.schema([("path", pa.string()), ("entry", pa.string()), ("content", pa.binary()), ("named", pa.list_(pa.string()))]))

    for batch in batches:
        for path in batch.column("path").to_pylist():
            with seeks.opened(path) as file:
                if path.endswith(suffix):
                    yield row(path, content=file.read())
                    continue
                with zipfile.ZipFile(file) as jar:
                    names = jar.namelist()
                    for name in sorted((n for n in names if n.endswith(suffix)), key=str.lower):
                        yield row(path, name, jar.read(name))
                    manifest = jar.read("META-INF/MANIFEST.MF").decode() if "META-INF/MANIFEST.MF" in names else ""
            others = re.search(r"(?m)^Class-Path: *(.*)$", re.sub(r"\r?\n ", "", manifest))
            yield row(path, named=[p for name in (others[1].split() if others else []) for p in _followed(path, name, suffix)])


def _followed(jar: str, name: str, suffix: str) -> Iterator[str]:
    """What a name in a jar's Class-Path leads to: a jar, a document or the documents below a folder; nothing if there is none."""
    scheme, inner = re.match(r"(file:(?=/)|[a-z0-9+.-]+://[^/]*|)(.*)", jar, re.S).groups()
    path = scheme + posixpath.normpath(posixpath.join(posixpath.dirname(inner), name))
    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        yield from (scheme + f.path if f.path.startswith("/") or not scheme.endswith(":") else f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.endswith(suffix))
    elif info.type == fs.FileType.File and path.endswith((suffix, ".jar")):
        yield path


def feather(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Feather files, each read where its bytes are, a batch of its rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with pa.ipc.open_file(pa.py_buffer(content.as_py())) as reader:
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def dated_files(logs: DataFrame) -> DataFrame:
    """logs: project, value, a log of a repository: lines of a time in seconds, then the files changed then, then an empty line, newest first.
    (project, path, changed_at) of each file once, at the first place that names it: the newest."""
    rows = logs.select("project", F.posexplode(F.split("value", "\n\n+")).alias("i", "block"))
    rows = rows.select("project", "i", F.split(F.trim(F.regexp_replace("block", r"^\n+|\n+$", "")), "\n").alias("lines"))
    rows = rows.select("project", "i", F.get("lines", 0).try_cast("long").alias("changed_at"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("j", "path"))
    first = rows.where("changed_at IS NOT NULL AND path <> ''").groupBy("project", "path").agg(F.min_by("changed_at", F.struct("i", "j")).alias("changed_at"))
    return first.select("project", "path", "changed_at")


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_hash, text): MD5 of the bytes as they are, text from UTF-16 by its mark or UTF-8; archives and
    class files are left out."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    start = F.hex(F.substring("content", 1, 4))
    raw = raw.where(~start.startswith("504B0304") & ~start.startswith("CAFEBABE"))
    text = F.when(start.startswith("FFFE") | start.startswith("FEFF"), F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    return raw.select("path", F.md5("content").alias("file_hash"), text.alias("text"))


def newest_per_path(history: DataFrame) -> DataFrame:
    """history: path, changed_at. The newest row of each path."""
    from lodestone.functions.rstats import first_per_key

    return first_per_key(history, ["path"], [F.desc("changed_at")])
