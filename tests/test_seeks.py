"""Streams, logs and quoted text read in parts, and framed files written, against reading all at once."""

import itertools
import os
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.sources import framed, messages, readers, seeks

MESSAGES = [b"abc", b"", b"z" * 300, b"\0" * 70_000, b"q", b"x" * 129]
HEADS = {"int32": lambda n: struct.pack(">i", n), "varint": framed.FRAMES["varint"]}


def stream(path, found, framing):
    path.write_bytes(b"".join(HEADS[framing](len(m)) + m for m in found))
    return str(path)


@pytest.mark.parametrize("framing", ["int32", "varint"])
@pytest.mark.parametrize("split", [1, 200, 1 << 20])
def test_messages_whatever_the_splits(spark, tmp_path, framing, split):
    stream(tmp_path / "a.bin", MESSAGES, framing)
    stream(tmp_path / "b.bin", MESSAGES[:2], framing)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = seeks.framed_messages(spark, str(tmp_path), framing, split=split).collect()
    by = {name: [bytes(r.message) for r in sorted(got, key=lambda r: r.ordinal) if r.path.endswith(name)] for name in ("a.bin", "b.bin")}
    assert by == {"a.bin": MESSAGES, "b.bin": MESSAGES[:2]} and len(got) == 8
    assert [r.ordinal for r in sorted(got, key=lambda r: r.ordinal) if r.path.endswith("a.bin")] == list(range(6))


def test_splits_begin_and_end_between_messages(spark, tmp_path):
    path = stream(tmp_path / "a.bin", [b"x" * 96] * 50, "int32")
    got = sorted((r.start, r.end, r.ordinal) for r in seeks.framed_splits(spark, path, split=1000).collect())
    assert got == [(1000 * i, 1000 * i + 1000, 10 * i) for i in range(5)]


def test_first_messages_are_read_alone(spark, tmp_path):
    path = stream(tmp_path / "a.bin", MESSAGES, "int32")
    with open(path, "ab") as out:
        out.write(b"\x7f\xff\xff\xff")  # what follows can't be read
    assert [bytes(r.message) for r in seeks.framed_messages(spark, path, first=2).orderBy("ordinal").collect()] == MESSAGES[:2]
    with pytest.raises(PySparkException, match="within a message"):
        seeks.framed_messages(spark, path).collect()
    (tmp_path / "short.bin").write_bytes(b"\0\0")
    with pytest.raises(PySparkException, match="within a size"):
        seeks.framed_messages(spark, str(tmp_path / "short.bin")).collect()


def test_a_file_larger_than_what_is_read(spark, tmp_path):
    """A sparse file of 8 GB: its first messages and its splits come without reading it."""
    with open(tmp_path / "big.bin", "wb") as out:
        for _ in range(4):
            out.write(struct.pack(">i", (1 << 31) - 1))
            out.seek((1 << 31) - 1, os.SEEK_CUR)
        out.truncate()
    got = seeks.framed_splits(spark, str(tmp_path / "big.bin")).collect()
    assert [r.ordinal for r in got] == [0, 1, 2, 3] and got[-1].end == 4 * ((1 << 31) + 3)


@pytest.mark.parametrize("framing", ["int32", "varint"])
def test_written_messages_are_read_again(spark, tmp_path, framing):
    to = str(tmp_path / "out")
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(MESSAGES)] + [(9, None)], "i int, message binary").repartition(3)
    sizes = framed.write_framed(df, to, framing)
    size = sum(len(m) + len(HEADS[framing](len(m))) for m in MESSAGES)
    assert sizes == {"bytes": size, "messages": 6} and sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) == size
    assert sorted(bytes(r.message) for r in seeks.framed_messages(spark, to, framing).collect()) == sorted(MESSAGES)
    assert framed.write_framed(df.limit(2), to, framing, mode="append")["messages"] == 8
    assert framed.write_framed(df.where("i = 0"), to, framing) == {"bytes": len(HEADS[framing](3)) + 3, "messages": 1}
    assert sorted(os.listdir(to))[0] == "_SIZES" and len(os.listdir(to)) == 2


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    to = str(tmp_path / "out")
    framed.write_framed(spark.createDataFrame([(bytearray(b"a"),)], "message binary"), to)
    before, seen = sorted(os.listdir(to)), lambda: sorted(n for n in os.listdir(to) if n != "_temporary")  # tasks that are killed may be late there
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("m")).cast("binary").alias("message"))
    with pytest.raises(PySparkException):
        framed.write_framed(bad, to)
    assert seen() == before and framed.read_sizes(to) == {"bytes": 5, "messages": 1}
    with pytest.raises(Exception, match="message"):
        framed.write_framed(spark.range(1).select(F.lit(b"").alias("other")), to)


def test_last_lines_read_little(tmp_path):
    class Counting:
        def __init__(self, file):
            self.file, self.n = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.n += n
            return self.file.read(n)

    for text, n in ((b"", 3), (b"\n", 2), (b"a", 1), (b"a\nb\r\nc\n", 2), (b"a\nb\n\n", 2), (b"x\n" * 200_000, 20), ("é\n".encode() * 50, 7), (b"one long line" * 9_000 + b"\nend", 2), (b"a\n", 0)):
        (tmp_path / "l").write_bytes(text)
        with open(tmp_path / "l", "rb") as f:
            file = Counting(f)
            got = seeks.last_lines(file, len(text), n)
        whole = text.decode().removesuffix("\n").replace("\r\n", "\n").split("\n")
        assert got == (whole[-n:] if n else [])
        assert file.n <= max(1 << 15, 2 * sum(len(x) + 2 for x in got))


def test_scans_agree_from_any_cut(spark):
    """From every place, in the state that a scan from the start has there, a scan ends as the whole does; transitions say the same."""
    g = random.Random(3)
    for _ in range(300):
        data = "".join(g.choices('a,"\\\n', weights=[4, 2, 3, 2, 2], k=g.randint(1, 40))).encode()
        whole = seeks.scan(data, seeks.RECORD)[0]
        for cut in range(len(data) + 1):
            ends, firsts = seeks.transitions(data[cut:])
            state = seeks.scan(data[:cut], seeks.RECORD)[0]
            assert ends[state] == whole
            starts = [i for i in range(cut, len(data)) if seeks.scan(data[:i], seeks.RECORD)[0] == seeks.RECORD]
            assert firsts[state] == (starts[0] - cut if starts else -1)


def quoted(g):
    field = lambda: '"' + "".join(g.choices(["a", "é", ",", '\\"', "\\\\", "\\\n", "\\n", "\r"], k=g.randint(0, 6))) + '"' if g.random() < 0.6 else "".join(g.choices("ab\\é", k=g.randint(0, 4)))
    return "".join(",".join(field() for _ in range(g.randint(1, 4))) + "\n" for _ in range(g.randint(1, 12)))


def test_records_whatever_the_pieces(spark, tmp_path):
    g = random.Random(4)
    texts = [quoted(g) for _ in range(6)] + ["", "\n", '1,"open\n2,x', 'a,"last \\\n one"']
    for i, text in enumerate(texts):
        (tmp_path / f"{i:02}.csv").write_bytes(text.encode())
    want = {i: list(readers.backslash_rows(t, True)) for i, t in enumerate(texts) if t}
    for split in (1, 2, 3, 7, 1000):
        got = {}
        for r in seeks.quoted_records(spark, str(tmp_path), lambda t: readers.backslash_rows(t, True), split).collect():
            got.setdefault(int(r.path[-6:-4]), []).append(list(r.row))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}, split


def test_text_documents(spark, tmp_path):
    documents = [
        {"uri": "A.scala", "language": 1, "md5": "ff", "symbols": [{"symbol": "p/A#", "kind": 13, "properties": 4, "display_name": "A", "language": 1}, {"symbol": "p/A#m().", "kind": 3, "display_name": "m"}],
         "occurrences": [{"range": {"start_line": 1, "start_col": 2, "end_line": 1, "end_col": 3}, "symbol": "p/A#", "role": 2}, {"symbol": "p/B#", "role": 1}], "synthetics": [{"range": {"start_line": 4}}]},
        {"uri": "B.scala", "symbols": [], "occurrences": [], "synthetics": []},
    ]
    stream(tmp_path / "s.bin", [messages.encode(d, "DOCUMENT") for d in documents], "varint")
    got = messages.read_text_documents(spark, str(tmp_path / "s.bin"))
    assert sorted(map(tuple, got["documents"].collect())) == [("A.scala", "SCALA", "ff", 2, 2, 1), ("B.scala", "UNKNOWN_LANGUAGE", "", 0, 0, 0)]
    assert sorted(map(tuple, got["symbols"].collect())) == [("A.scala", "p/A#", "CLASS", 4, "A", "SCALA"), ("A.scala", "p/A#m().", "METHOD", 0, "m", "UNKNOWN_LANGUAGE")]
    assert sorted(got["occurrences"].collect(), key=lambda r: r.pos) == [("A.scala", 0, "p/A#", "DEFINITION", 1, 2, 1, 3), ("A.scala", 1, "p/B#", "REFERENCE", None, None, None, None)]
    whole = messages.encode({"documents": documents}, "DOCUMENTS")
    assert messages.text_documents(spark.createDataFrame([(bytearray(whole),)], "message binary"), "DOCUMENTS")["occurrences"].count() == 2
    assert list(itertools.chain.from_iterable(messages.document_rows(d) for d in messages.decode(whole, "DOCUMENTS")["documents"]))[0][1]["md5"] == "ff"


def test_text_documents_are_rows_without_json(spark):
    """Numbers beyond 32 bits are null, as before; rows have their columns' types where they are decoded."""
    whole = messages.encode({"uri": "A", "occurrences": [{"range": {"start_line": 1 << 40, "start_col": -1}, "symbol": "s" * 300, "role": 77}], "symbols": []}, "DOCUMENT")
    found = messages.text_documents(spark.createDataFrame([(bytearray(whole),)], "message binary"))
    assert [tuple(r) for r in found["occurrences"].collect()] == [("A", 0, "s" * 300, None, None, -1, 0, 0)]
    assert "from_json" not in found["occurrences"]._jdf.queryExecution().optimizedPlan().toString()


def test_modules_of_a_message_are_decoded_and_encoded_one_at_a_time():
    import tracemalloc

    import pandas as pd

    rows = pd.DataFrame({"module_id": [f"m{i}" for i in range(20_000)], "project_id": "p", "call_sites_count": range(20_000)})
    whole = messages.encode({"project_id": "p", "sbt_version": "", "modules": {r["module_id"]: r for r in rows.sort_values("module_id").to_dict("records")}}, "PROJECT")
    assert messages.message_of("p", rows) == whole
    tracemalloc.start()
    assert [m["call_sites_count"] for m in messages.modules_in(whole) if m["module_id"] in ("m7", "m19999")] == [19_999, 7]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    messages.decode(whole, "PROJECT")
    assert peak < tracemalloc.get_traced_memory()[1] / 2
    tracemalloc.stop()
    twice = messages.encode({"modules": {"a": {"module_id": "old"}}}, "PROJECT") + messages.encode({"modules": {"a": {"module_id": "new"}}}, "PROJECT")
    assert [m["module_id"] for m in messages.modules_in(twice)] == ["new"]


def test_modules_are_decoded_before_any_project_was_planned(monkeypatch):
    data = messages.encode({"project_id": "p", "sbt_version": "", "modules": {"m": {"module_id": "m", "project_id": "p"}}}, "PROJECT")
    monkeypatch.setattr(messages, "_PLANS", {})  # as in a fresh worker
    monkeypatch.setattr(messages, "FIELDS", {k: v for k, v in messages.FIELDS.items() if not k.startswith("ENTRY ")})
    assert [m["module_id"] for m in messages.modules_in(data)] == ["m"]
