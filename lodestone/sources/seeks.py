"""Reading parts of files in tasks: streams of framed messages, logs by their ends, quoted text in pieces, entries of archives.

Spark lists the files and tasks open them to seek, so that nothing is read that isn't wanted and no file, however large, is one value or, but for
the walk over its sizes, one task. Paths are those that pyarrow's file systems open: local ones and those of the usual stores."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lineage import counted

#: Splits and pieces of files have about this many bytes, whatever the file.
SPLIT = 32 << 20


def opened(path: str) -> pa.NativeFile:
    """The file, to read and to seek."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, length) of the files at path; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length")


def _spread(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """A task for each row, up to `most` tasks: rows are few and stand for much. Runs what makes them."""
    rows, n = counted(rows, F.lit(True))
    return rows.repartition(max(1, min(n, most)), *rows.columns)


# ---- framed messages ---------------------------------------------------------------------------


class _Window:
    """Bytes of a file around where it was last asked for."""

    def __init__(self, file: pa.NativeFile, size: int, width: int = 1 << 16):
        self.file, self.size, self.width, self.start, self.data = file, size, width, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the end."""
        if not self.start <= at <= at + n <= self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, min(self.width, self.size - at)))
        return self.data[at - self.start : at - self.start + n]


def _size_at(window: _Window, at: int, framing: str) -> tuple[int, int]:
    """The size of the message whose frame begins at `at`, and where the message begins."""
    if framing == "int32":
        head = window.get(at, 4)
        if len(head) < 4:
            raise OSError("stream ends within a size")
        return struct.unpack(">i", head)[0], at + 4
    size = shift = 0
    while True:
        byte = window.get(at, 1)
        if not byte:
            raise OSError("stream ends within a size")
        size, shift, at = size | (byte[0] & 127) << shift, shift + 7, at + 1
        if byte[0] < 128:
            return size, at


def _sizes(window: _Window, framing: str, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(start of the frame, start of the message, size) of each; a stream that ends within a message is an error, at a boundary it has ended."""
    end = window.size if end is None else end
    while at < end:
        size, begin = _size_at(window, at, framing)
        if size < 0 or begin + size > window.size:
            raise OSError("stream ends within a message")
        yield at, begin, size
        at = begin + size


def framed_splits(spark: SparkSession, path: str, framing: str = "int32", first: int | None = None, split: int = SPLIT) -> DataFrame:
    """(path, start, end, ordinal): ranges of about `split` bytes of the streams at path that begin and end between messages, with the number of
    the first. A walk seeks from size to size, a task a file; with `first` it ends after so many messages of each file."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length in zip(pdf["path"], pdf["length"]):
                with opened(name) as file:
                    start, ordinal, at, out, n = 0, 0, 0, [], 0
                    for n, (_, begin, size) in enumerate(_sizes(_Window(file, length), framing), 1):
                        at = begin + size
                        if at - start >= split or n == first:
                            out.append((name, start, at, ordinal))
                            start, ordinal = at, n
                        if n == first:
                            break
                    if at > start:
                        out.append((name, start, at, ordinal))
                yield pd.DataFrame(out, columns=["path", "start", "end", "ordinal"])

    return files(spark, path).mapInPandas(walk, "path string, start long, end long, ordinal long")


def framed_messages(spark: SparkSession, path: str, framing: str = "int32", first: int | None = None, split: int = SPLIT) -> DataFrame:
    """(path, ordinal, message) of the streams of framed messages at path, each behind its size: 4 bytes big-endian (int32) or a varint. Streams may be of
    any length, messages of up to 2 GB; with `first`, only so many of each file are read. The walk over sizes runs when this is called."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary())], ["path", "ordinal", "message"])

        for b in batches:
            for r in b.to_pylist():
                with opened(r["path"]) as file:
                    held, size_held = [], 0
                    window = _Window(file, r["end"], 1 << 20)
                    for i, (_, begin, size) in enumerate(_sizes(window, framing, r["start"], r["end"])):
                        held.append((r["path"], r["ordinal"] + i, window.get(begin, size)))
                        size_held += size
                        if size_held > 8 << 20:
                            yield batch(held)
                            held, size_held = [], 0
                    if held:
                        yield batch(held)

    return _spread(framed_splits(spark, path, framing, first, split)).mapInArrow(read, "path string, ordinal long, message binary")


# ---- the ends of logs --------------------------------------------------------------------------


def last_lines(file: pa.NativeFile, length: int, n: int, block: int = 1 << 14) -> list[str]:
    """The last n lines, read backwards in blocks until they are there; lines end by LF or CR LF, the last one by the file's end too."""
    data, at = b"", length
    while at and data.count(b"\n", 0, max(0, len(data) - 1)) < n:
        step = min(block, at)
        at -= step
        file.seek(at)
        data = file.read(step) + data
        block *= 2
    lines = re.split(rb"\r?\n", re.sub(rb"\r?\n\Z", b"", data))
    return [x.decode("utf-8", "replace") for x in lines[-n:]] if n > 0 else []


def log_tails(spark: SparkSession, path: str, lines: int = 20) -> DataFrame:
    """(path, lines): the last lines of each log. What is read doesn't grow with the log."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for name, length in zip(pdf["path"], pdf["length"]):
                with opened(name) as file:
                    found.append(last_lines(file, length, lines))
            yield pd.DataFrame({"path": pdf["path"], "lines": found})

    return files(spark, path).mapInPandas(run, "path string, lines array<string>")


# ---- quoted text in pieces ---------------------------------------------------------------------

# Where a scan of quoted text can be: at a record's start, at a field's, in a bare field (or behind a closing quote), in quotes, and there behind a
# backslash.
RECORD, FIELD, BARE, QUOTED, ESCAPED = range(5)
_NEXT = {BARE: re.compile(rb"[,\n]"), QUOTED: re.compile(rb'[\\"\n]')}


def scan(data: bytes, state: int, at: int = 0, to_record: bool = False) -> tuple[int, int]:
    """(state, place) where a scan of the data ends that begins in the state: at its end, or with to_record where the next record starts, which may
    be at once. An unescaped line end ends a record, also in a quoted field."""
    n = len(data)
    while at < n and not (to_record and state == RECORD):
        if state in (RECORD, FIELD):
            c = data[at]
            state, at = (QUOTED, at + 1) if c == 34 else (FIELD, at + 1) if c == 44 else (RECORD, at + 1) if c == 10 else (BARE, at)
        elif state == ESCAPED:
            state, at = QUOTED, at + 1
        else:
            m = _NEXT[state].search(data, at)
            if not m:
                return state, n
            c, at = m[0], m.end()
            state = RECORD if c == b"\n" else FIELD if c == b"," else ESCAPED if c == b"\\" else BARE
    return state, at


def transitions(data: bytes) -> tuple[list[int], list[int]]:
    """For each state that a piece can begin in: the state it ends in, and where its first record starts (-1: in none). Scans meet at the first
    record that starts for sure, so the rest is scanned once."""
    ends, firsts, rest = [], [], {}
    for state in range(5):
        end, at = scan(data, state, to_record=True)
        if end == RECORD and at < len(data):
            if at not in rest:
                rest[at] = scan(data, RECORD, at)[0]
            ends.append(rest[at])
            firsts.append(at)
        else:
            ends.append(end)
            firsts.append(-1)
    return ends, firsts


def quoted_records(spark: SparkSession, path: str, parse: Callable[[str], Iterator[list[str]]], split: int = SPLIT) -> DataFrame:
    """(path, row): the records of quoted text files, in which fields are quoted by `"`, a backslash in quotes escapes any character, a line end too, and commas
    stand between fields; parse makes rows of a text of whole records.

    A file is read in pieces of `split` bytes by as many tasks. Whether a piece begins in quotes depends on all before it, so first each piece tells where it
    would end for each state that it might begin in; these, five numbers a piece, are put one behind the other, and then each piece
    parses the records that start in it, reading on to the end of the last. The first pass runs when this is called."""
    last = F.greatest(F.lit(0), F.floor((F.col("length") - 1) / split))
    pieces = files(spark, path).where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))

    def bytes_of(file, piece: int) -> bytes:
        file.seek(piece * split)
        return file.read(split)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length, piece in zip(pdf["path"], pdf["length"], pdf["piece"]):
                with opened(name) as file:
                    ends, firsts = transitions(bytes_of(file, piece))
                yield pd.DataFrame({"path": [name], "length": [length], "piece": [piece], "ends": [ends], "firsts": [firsts]})

    judged, _ = counted(_spread(pieces).mapInPandas(judge, "path string, length long, piece long, ends array<int>, firsts array<long>"), F.lit(True))
    known, state, before = [], RECORD, None
    for r in judged.select("path", "piece", "ends", "firsts").orderBy("path", "piece").toLocalIterator():
        state = RECORD if r.path != before else state
        if r.firsts[state] >= 0:
            known.append((r.path, r.piece, r.firsts[state], r.ends[state]))
        state, before = r.ends[state], r.path

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, piece, first, state in zip(pdf["path"], pdf["piece"], pdf["first"], pdf["state"]):
                with opened(name) as file:
                    data, more = [bytes_of(file, piece)[first:]], True
                    while state != RECORD and more:  # the last record goes on
                        more = file.read(1 << 16)
                        state, at = scan(more, state, to_record=True)
                        data.append(more[:at])
                rows = []
                for row in parse(b"".join(data).decode("utf-8")):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame({"path": name, "row": rows})
                        rows = []
                if rows:
                    yield pd.DataFrame({"path": name, "row": rows})

    starts = spark.createDataFrame(known, "path string, piece long, first long, state int").repartition(max(1, min(len(known), 10_000)), "path", "piece")
    return starts.mapInPandas(read, "path string, row array<string>")
