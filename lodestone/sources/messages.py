"""The model's messages: reading framed files of projects into model tables, and writing them.

A message is decoded where its bytes are, into rows of the model tables as JSON, which Spark reads by schema. One message is one
project, as the format has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lodestone.operators.lineage import materialise
from lodestone.operators.model import Model
from lodestone.operators.types import REF
from lodestone.sources.seeks import framed_messages

# The messages' fields by number, as name and kind; names in capitals are messages, * is repeated, {} a map of text to it.
FIELDS = {
    "POSITION": {1: ("start_line", "int"), 2: ("start_col", "int"), 3: ("end_line", "int"), 4: ("end_col", "int")},
    "LOCATION": {1: ("path", "text"), 2: ("uri", "text"), 3: ("position", "POSITION")},
    "PATH": {1: ("source", "SOURCE"), 2: ("class", "CLASSPATH")},
    "SOURCE": {1: ("path", "text"), 2: ("scope", "text"), 3: ("managed", "bool")},
    "CLASSPATH": {1: ("path", "text"), 2: ("group_id", "text"), 3: ("artifact_id", "text"), 4: ("version", "text"), 5: ("scope", "text"), 6: ("internal", "bool"), 7: ("managed", "bool"), 8: ("transitive", "bool")},
    "PROJECT": {1: ("project_id", "text"), 2: ("sbt_version", "text"), 3: ("modules", "{}MODULE")},
    "MODULE": {
        1: ("module_id", "text"), 2: ("project_id", "text"), 3: ("group_id", "text"), 4: ("artifact_id", "text"), 5: ("version", "text"), 6: ("commit", "text"), 7: ("scala_version", "text"),
        8: ("paths", "{}PATH"), 9: ("declarations", "{}DECLARATION"), 10: ("call_sites", "*CALL"), 11: ("call_sites_count", "int"), 12: ("test_call_sites_count", "int"),
    },
    "DECLARATION": {
        1: ("declaration_id", "text"), 2: ("module_id", "text"), 3: ("kind", "int"), 4: ("properties", "int"), 5: ("name", "text"), 6: ("access", "int"), 7: ("location", "LOCATION"), 8: ("language", "int"),
        9: ("annotations", "*REF"), 10: ("signature", "SIGNATURE"),
    },
    "SIGNATURE": {1: ("type", "TYPE"), 2: ("class", "CLASS"), 3: ("method", "METHOD"), 4: ("value", "VALUE")},
    "METHOD": {3: ("type_parameters", "*REF"), 4: ("parameter_lists", "*LIST"), 5: ("result", "REF")},
    "TYPE": {1: ("type_parameters", "*REF"), 2: ("upper", "REF"), 3: ("lower", "REF")},
    "CLASS": {1: ("type_parameters", "*REF"), 2: ("parents", "*REF")},
    "VALUE": {1: ("result", "REF")},
    "LIST": {1: ("parameters", "*PARAMETER")},
    "PARAMETER": {1: ("name", "text"), 2: ("type", "REF"), 3: ("is_implicit", "bool")},
    "REF": {1: ("id", "text"), 2: ("args", "*REF")},
    "CALL": {
        1: ("call_site_id", "int"), 2: ("parent_id", "int"), 3: ("module_id", "text"), 4: ("declaration_id", "text"), 5: ("code", "text"), 6: ("location", "LOCATION"), 7: ("type_arguments", "*REF"), 8: ("args", "*ARGUMENT"),
    },
    "ARGUMENT": {1: ("value", "VALUE_ARGUMENT"), 2: ("call", "CALL_ARGUMENT")},
    "VALUE_ARGUMENT": {1: ("declaration_id", "text")},
    "CALL_ARGUMENT": {1: ("callsite_id", "int")},
    # text documents of a compiler's symbols
    "KEY": {1: ("key", "text")},  # of a map's entry
    "DOCUMENTS": {1: ("documents", "*DOCUMENT")},
    "DOCUMENT": {1: ("schema", "int"), 2: ("uri", "text"), 3: ("text", "text"), 5: ("symbols", "*SYMBOL"), 6: ("occurrences", "*OCCURRENCE"), 10: ("language", "int"), 11: ("md5", "text"), 12: ("synthetics", "*SYNTHETIC")},
    "SYMBOL": {1: ("symbol", "text"), 3: ("kind", "int"), 4: ("properties", "int"), 5: ("display_name", "text"), 16: ("language", "int")},
    "OCCURRENCE": {1: ("range", "RANGE"), 2: ("symbol", "text"), 3: ("role", "int")},
    "RANGE": {1: ("start_line", "int"), 2: ("start_col", "int"), 3: ("end_line", "int"), 4: ("end_col", "int")},
    "SYNTHETIC": {1: ("range", "RANGE")},
}
# Names of numbers.
KINDS = ("DEF", "VAL", "VAR", "TYPE", "CLASS", "TRAIT", "OBJECT", "INTERFACE", "ENUM", "MACRO", "TYPE_PARAMETER", "PARAMETER")
ACCESS = ("PRIVATE", "PRIVATE_THIS", "PRIVATE_WITHIN", "PROTECTED", "PROTECTED_THIS", "PROTECTED_WITHIN", "PUBLIC", "NOT_SPECIFIED")
LANGUAGES = ("UNKNOWN_LANGUAGE", "SCALA", "JAVA")
SYMBOL_KINDS = {
    3: "METHOD", 6: "MACRO", 7: "TYPE", 8: "PARAMETER", 9: "TYPE_PARAMETER", 10: "OBJECT", 11: "PACKAGE", 12: "PACKAGE_OBJECT", 13: "CLASS", 14: "TRAIT", 17: "SELF_PARAMETER", 18: "INTERFACE", 19: "LOCAL",
    20: "FIELD", 21: "CONSTRUCTOR",
}
ROLES = ("UNKNOWN_ROLE", "REFERENCE", "DEFINITION")

PARAMS = f"array<array<struct<name: string, type: {REF}, is_implicit: boolean>>>"
TABLES = {
    "modules": "module_id string, project_id string, group_id string, artifact_id string, version string, commit string, scala_version string, call_sites_count int, test_call_sites_count int",
    "paths": "module_id string, path string, entry_kind string, scope string, managed boolean, group_id string, artifact_id string, version string, internal boolean, transitive boolean",
    "declarations": f"module_id string, declaration_id string, kind string, properties int, name string, access string, location_path string, location_uri string, line int, col int, language string, annotations array<string>, sig_kind string, type_parameters array<string>, parents array<{REF}>, upper {REF}, lower {REF}, result {REF}, parameter_lists {PARAMS}",
    "call_sites": f"module_id string, call_site_id int, parent_id int, declaration_id string, code string, location_path string, location_uri string, line int, col int, type_arguments array<{REF}>",
    "args": "module_id string, call_site_id int, pos int, callsite_id int, declaration_id string",
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _plan(kind: str) -> tuple[dict, list, list]:
    """Of a kind of message, made once: by number (name, * or {} or nothing, bare kind); repeated names and whether they are maps; and in order (name, the
    same, tag of a number, tag of bytes)."""
    found = _PLANS.get(kind)
    if found is None:
        numbered = {1: ("key", "text"), 2: ("value", kind[6:])} if kind.startswith("ENTRY ") else FIELDS[kind]  # of a map, whether its message was planned here or not
        fields = [(number, name, k[0] if k[0] in "{*" else "", k.lstrip("{}*")) for number, (name, k) in numbered.items()]
        by_number = {number: (name, many, bare) for number, name, many, bare in fields}
        found = _PLANS[kind] = by_number, [(name, many == "{") for _, name, many, _ in fields if many], [(name, many, bare, _number(n << 3), _number(n << 3 | 2)) for n, name, many, bare in fields]
    return found


_PLANS: dict[str, tuple[dict, list, list]] = {}


def decode(data: bytes, kind: str) -> dict:
    """A message as a dictionary; repeated fields as lists, maps as dictionaries; unknown fields are passed over."""
    fields, repeated, _ = _plan(kind)
    out = {name: {} if of_keys else [] for name, of_keys in repeated}
    at, n = 0, len(data)
    while at < n:
        tag, at = data[at], at + 1
        if tag > 127:
            tag, at = _varint(data, at - 1)
        wire = tag & 7
        if wire == 0 or wire == 2:
            value, at = data[at], at + 1
            if value > 127:
                value, at = _varint(data, at - 1)
            if wire == 2:
                value, at = data[at : at + value], at + value
        else:
            value, at = None, at + (8 if wire == 1 else 4)
        field = fields.get(tag >> 3)
        if field is None or value is None:
            continue
        name, many, bare = field
        if many == "{":
            entry = _entry(value, bare)
            out[name][entry[0]] = entry[1]
            continue
        value = value.decode() if bare == "text" else bool(value) if bare == "bool" else (value - (1 << 64) if value >> 63 else value) if bare == "int" else decode(value, bare)
        if many:
            out[name].append(value)
        else:
            out[name] = value
    return out


def _entry(data: bytes, kind: str) -> tuple[str, dict]:
    entry = decode(data, f"ENTRY {kind}")
    return entry["key"], entry["value"]


_SMALL = [bytes([i]) for i in range(128)]


def _number(value: int) -> bytes:
    if 0 <= value < 128:
        return _SMALL[value]
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def encode(message: dict, kind: str) -> bytes:
    """What decode() reads. Fields that are missing or None are left out."""
    out = bytearray()
    for name, many, bare, of_number, of_bytes in _plan(kind)[2]:
        value = message.get(name)
        if value is None:
            continue
        values = [{"key": a, "value": b} for a, b in value.items()] if many == "{" else value if many else (value,)
        within = f"ENTRY {bare}" if many == "{" else bare
        for x in values:
            if within == "int" or within == "bool":
                out += of_number + _number(int(x))
            else:
                x = x.encode() if within == "text" else encode(x, within)
                out += of_bytes + _number(len(x)) + x
    return bytes(out)


def _flat(ref: dict | None, depth: int = 0) -> list | None:
    if ref is None:
        return None
    return [{"id": ref["id"], "depth": depth}, *(n for a in ref["args"] for n in _flat(a, depth + 1))]


def _place(location: dict) -> dict:
    position = location.get("position") or {}
    return {"location_path": location["path"], "location_uri": location["uri"], "line": position.get("start_line"), "col": position.get("start_col")}


def modules_in(data: bytes) -> Iterator[dict]:
    """The modules of a project's message, decoded one at a time: what is held of all are ids and places. Of equal ids the last counts."""
    (modules,) = (number for number, (name, _) in FIELDS["PROJECT"].items() if name == "modules")
    places, at = {}, 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 2:
            size, at = _varint(data, at)
            if tag >> 3 == modules:
                places[decode(data[at : at + size], "KEY")["key"]] = at, at + size
            at += size
        else:
            at = _varint(data, at)[1] if wire == 0 else at + (8 if wire == 1 else 4)
    for start, end in places.values():
        yield _entry(data[start:end], "MODULE")[1]


def project_rows(modules: Iterable[dict]) -> Iterator[tuple[str, dict]]:
    """(table, row) of a project's modules."""
    for m in modules:
        key = {"module_id": m["module_id"]}
        yield "modules", {k: m.get(k) for k in ("module_id", "project_id", "group_id", "artifact_id", "version", "commit", "scala_version", "call_sites_count", "test_call_sites_count")}
        for at, p in m["paths"].items():
            kind = "source" if "source" in p else "class"
            yield "paths", {**p.get(kind, {}), **key, "path": at, "entry_kind": kind}
        for d in m["declarations"].values():
            kind, s = next(iter(d["signature"].items()))
            lists = [[{**x, "type": _flat(x["type"])} for x in one["parameters"]] for one in s.get("parameter_lists", [])]
            yield "declarations", {
                **key, **{k: d[k] for k in ("declaration_id", "properties", "name")}, "kind": KINDS[d["kind"]], "access": ACCESS[d["access"]], "language": LANGUAGES[d["language"]], **_place(d["location"]),
                "annotations": [a["id"] for a in d["annotations"]], "sig_kind": kind, "type_parameters": [t["id"] for t in s.get("type_parameters", [])], "parents": [_flat(t) for t in s.get("parents", [])],
                "upper": _flat(s.get("upper")), "lower": _flat(s.get("lower")), "result": _flat(s.get("result")), "parameter_lists": lists,
            }
        for c in m["call_sites"]:
            own = {**key, "call_site_id": c["call_site_id"]}
            yield "call_sites", {**own, "parent_id": c.get("parent_id"), "declaration_id": c["declaration_id"], "code": c["code"], **_place(c["location"]), "type_arguments": [_flat(t) for t in c["type_arguments"]]}
            for i, a in enumerate(c["args"]):
                yield "args", {**own, "pos": i, **a.get("call", {}), **a.get("value", {})}


DOCUMENT_TABLES = {
    "documents": "uri string, language string, md5 string, symbols int, occurrences int, synthetics int",
    "symbols": "uri string, symbol string, kind string, properties int, display_name string, language string",
    "occurrences": "uri string, pos int, symbol string, role string, start_line int, start_col int, end_line int, end_col int",
}


def document_rows(document: dict) -> Iterator[tuple[str, dict]]:
    """(table, row) of a text document. A number that has no name is null, one that isn't sent is 0."""
    uri, name = {"uri": document.get("uri", "")}, lambda names, n: names[n] if n < len(names) else None
    lists = ("symbols", "occurrences", "synthetics")
    yield "documents", {**uri, "language": name(LANGUAGES, document.get("language", 0)), "md5": document.get("md5", ""), **{k: len(document[k]) for k in lists}}
    for s in document["symbols"]:
        yield "symbols", {**uri, "symbol": s.get("symbol", ""), "kind": SYMBOL_KINDS.get(s.get("kind", 0)), "properties": s.get("properties", 0), "display_name": s.get("display_name", ""), "language": name(LANGUAGES, s.get("language", 0))}
    for i, o in enumerate(document["occurrences"]):
        r = o.get("range")
        yield "occurrences", {**uri, "pos": i, "symbol": o.get("symbol", ""), "role": name(ROLES, o.get("role", 0)), **({k: r.get(k, 0) for k in ("start_line", "start_col", "end_line", "end_col")} if r else {})}


def text_documents(found: DataFrame, kind: str = "DOCUMENT") -> dict[str, DataFrame]:
    """Tables documents, symbols and occurrences of column message: each a text document, or with kind DOCUMENTS a list of them, as compilers write
    it into a file of its own."""
    whole = (lambda m: decode(m, "DOCUMENTS")["documents"]) if kind == "DOCUMENTS" else (lambda m: [decode(m, "DOCUMENT")])
    rows = materialise(_typed_rows_of(found, lambda m: (row for d in whole(m) for row in document_rows(d))))
    return {name: rows.where(F.col("name") == name).select(*StructType.fromDDL(schema).names) for name, schema in DOCUMENT_TABLES.items()}


def _typed_rows_of(found: DataFrame, rows_of) -> DataFrame:
    """(name and the columns of DOCUMENT_TABLES): the tables' rows, with nulls in columns of other tables. Integers that are out of range are null."""
    fields = {f.name: f.dataType for schema in DOCUMENT_TABLES.values() for f in StructType.fromDDL(schema)}
    ints = [name for name, kind in fields.items() if kind == IntegerType()]
    schema = pa.schema([("name", pa.string()), *((name, pa.int32() if name in ints else pa.string()) for name in fields)])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        try:
            return pa.RecordBatch.from_pylist(rows, schema)
        except (pa.ArrowInvalid, OverflowError):
            fits = lambda v: v is not None and -(1 << 31) <= v < 1 << 31
            return pa.RecordBatch.from_pylist([{k: v if k not in ints or fits(v) else None for k, v in r.items()} for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for message in b.column(0):
                for table, row in rows_of(message.as_py()):
                    row["name"] = table
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return found.select("message").mapInArrow(run, "name string, " + ", ".join(f"{name} {kind.simpleString()}" for name, kind in fields.items()))


def read_text_documents(spark: SparkSession, path: str, framing: str = "varint") -> dict[str, DataFrame]:
    """text_documents() of the streams of text documents at path."""
    return text_documents(framed_messages(spark, path, framing))


def read_projects(spark: SparkSession, path: str, framing: str = "int32") -> Model:
    """Model tables of the framed files of projects at path."""
    rows = materialise(_decoded(framed_messages(spark, path, framing)))
    return Model(**{name: _table(rows, name, schema) for name, schema in TABLES.items()})


def modules_of(found: DataFrame) -> DataFrame:
    """The modules of messages of projects."""
    return _table(_decoded(found), "modules", TABLES["modules"])


def _table(rows: DataFrame, name: str, schema: str) -> DataFrame:
    return rows.where(F.col("name") == name).select(F.from_json("row", schema).alias("r")).select("r.*")


def _decoded(found: DataFrame) -> DataFrame:
    return _rows_of(found, lambda message: project_rows(modules_in(message)))


def _rows_of(found: DataFrame, rows_of) -> DataFrame:
    """(name, row): of messages, the tables' rows as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for message in pdf["message"]:
                for table, row in rows_of(message):
                    rows.append((table, json.dumps(row)))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["name", "row"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["name", "row"])

    return found.select("message").mapInPandas(run, "name string, row string")


def encoded(rows: DataFrame, kind: str) -> DataFrame:
    """(message): of column json, each a message of the kind as JSON by the names of its fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"message": [encode(json.loads(x), kind) for x in pdf["json"]]})

    return rows.select("json").mapInPandas(run, "message binary")


def message_of(project_id: str, modules: pd.DataFrame) -> bytes:
    """A project's message of rows of modules, encoded one at a time. Of equal ids the last counts."""
    rows = modules.sort_values("module_id").drop_duplicates("module_id", keep="last")
    out = bytearray(encode({"project_id": project_id, "sbt_version": ""}, "PROJECT"))
    for values in rows.itertuples(index=False, name=None):
        row = dict(zip(rows.columns, values))
        out += encode({"modules": {row["module_id"]: row}}, "PROJECT")
    return bytes(out)


def module_messages(modules: DataFrame) -> DataFrame:
    """(project_id, message) of projects whose modules have nothing but their own fields, to be framed by writers.framed()."""
    columns = ("module_id", "project_id", "group_id", "artifact_id", "version", "commit", "scala_version", "call_sites_count", "test_call_sites_count")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"project_id": [key[0]], "message": [message_of(key[0], pdf[list(columns)])]})

    return modules.withColumn("module_id", F.col("module_id").cast("string")).groupBy("project_id").applyInPandas(run, "project_id string, message binary")
