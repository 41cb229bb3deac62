"""Readers and writers: JSON lines, whole JSON, CSV, parquet, workbooks, pinned files, logs, reports."""

from __future__ import annotations

import functools
import hashlib
import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ITEM_SCHEMA = "state string, q struct<type:string,instructions:string,criteria:string>, target array<double>, src string, lang string"
PREDICTION_SCHEMA = "suite string, lang string, i int, item string, gold int, pred int"
ACCESS_LOG_SCHEMA = "ts timestamp, level string, event string, request_id string, path string, status int, model string, adapter string, tokens bigint, ms double, remote string, key_id string"


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines, compressed or not; blank lines are skipped. ``strict`` fails on a bad line, else it becomes nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path if isinstance(path, str) else list(path))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, text) of lines that do not fit a schema."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("path", F.input_file_name())
    return rows.persist().where("_bad is not null").select("path", F.col("_bad").alias("text"))


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite", compressed: bool = True) -> None:
    """JSON lines. With an order, ranges are sorted and files are named by their number only: the same rows give the same files under the same names, as long as the bounds of the ranges, which Spark samples, are the same."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode(mode).json(path, compression="gzip" if compressed else "none")
    if order and mode == "overwrite":
        fs, at = _file_system(df.sparkSession, path)
        names = sorted(f.getPath().getName() for f in fs.listStatus(at(path)) if f.getPath().getName().startswith("part-"))
        for i, name in enumerate(names):
            fs.rename(at(f"{path}/{name}"), at(f"{path}/part-{i:05d}.json" + (".gz" if compressed else "")))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds records to a log."""
    df.write.mode("append").json(path, compression="gzip")


def read_any_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON document or JSON lines: an array or object first, lines otherwise."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str] = []
            for t in b["value"]:
                try:
                    v = json.loads(t)
                    out += [json.dumps(x, ensure_ascii=False) for x in (v if isinstance(v, list) else [v])]
                except ValueError:
                    out += [x for x in t.splitlines() if x.strip()]
            yield pd.DataFrame({"json": out})

    return text.mapInPandas(rows, "json string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are text."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = r.schema(schema).csv(path) if schema else r.csv(path)
    df = df.where(where) if where else df
    return df.limit(limit) if limit else df


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], where: str | None = None) -> DataFrame:
    """Parquet with pruned columns and a filter that reaches the scan."""
    df = spark.read.parquet(path)
    return (df.where(where) if where else df).select(*columns)


_SHEETS, _LINKS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CELL_AT = re.compile(r"([A-Z]+)\d*$")


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, formatted runs joined; phonetic guides are not part of it."""
    parts = [node.findtext(f"{{{_SHEETS}}}t") or ""]
    parts += [run.findtext(f"{{{_SHEETS}}}t") or "" for run in node.findall(f"{{{_SHEETS}}}r")]
    return "".join(parts)


def _column(ref: str | None, last: int) -> int:
    """0-based column of a cell reference; a cell without one stands right of the last."""
    at = _CELL_AT.match((ref or "").upper())
    return int(functools.reduce(lambda n, c: n * 26 + ord(c) - 64, at[1], 0)) - 1 if at else last + 1


def _first_sheet(z: zipfile.ZipFile) -> str | None:
    """The part of the sheet that the workbook lists first, found through its relations."""
    try:
        sheet = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f".//{{{_SHEETS}}}sheet")
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    except KeyError:
        return next((n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")), None)
    if sheet is None:
        return None
    target = links.get(sheet.get(f"{{{_LINKS}}}id"), "")
    return posixpath.normpath(posixpath.join("xl", target) if not target.startswith("/") else target.lstrip("/"))


def workbook_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet, cells as text, one at a time; absent cells are null, absent rows are empty lists.

    Booleans read TRUE and FALSE, numbers as they are stored, formulas by their stored result; errors are null.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        part = _first_sheet(z)
        if part is None:
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{{{_SHEETS}}}si":
                        shared.append(_text(node))
                        node.clear()
        done = 0
        with z.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_SHEETS}}}row":
                    continue
                number = int(row.get("r", done + 1))
                yield from ([] for _ in range(number - done - 1))
                done = number
                out: list[str | None] = []
                for cell in row:
                    kind, value = cell.get("t", "n"), cell.findtext(f"{{{_SHEETS}}}v")
                    if kind == "inlineStr":
                        inline = cell.find(f"{{{_SHEETS}}}is")
                        value = None if inline is None else _text(inline)
                    elif value is not None:
                        value = {"s": lambda v: shared[int(v)], "b": lambda v: "FALSE" if v == "0" else "TRUE", "e": lambda v: None}.get(kind, str)(value)
                    at = _column(cell.get("r"), len(out) - 1)
                    out += [None] * (at + 1 - len(out))
                    out[at] = value
                yield out
                row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells): the rows of the first sheet of each workbook."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = list(workbook_rows(bytes(c)))
                yield pd.DataFrame({"path": p, "row": range(len(rows)), "cells": rows})

    return files.mapInPandas(run, "path string, row int, cells array<string>")


def pinned(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """(path, sha256, ok) of files against their pinned digests by file name; a file without one is not ok."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    want = F.element_at(F.create_map(*(F.lit(x) for kv in (digests or {"": ""}).items() for x in kv)), F.element_at(F.split("path", "/"), -1))
    return files.withColumn("ok", F.coalesce(F.col("sha256") == want, F.lit(False)))


def read_pinned(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """(path, content) of files that all have their pinned digest; raises if one differs, has none or is missing."""
    found = pinned(spark, path, digests).collect()  # one row per file
    bad = sorted(r["path"] for r in found if not r["ok"])
    missing = sorted(set(digests) - {r["path"].rpartition("/")[2] for r in found})
    if bad or missing:
        raise ValueError(f"digests differ: {bad}; missing: {missing}")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_pair(df: DataFrame, out: str, manifest: dict) -> dict:
    """Publishes rows together with a manifest under ``out``, in any Hadoop file system.

    Each publication is a folder of its own; a small file ``current`` names the one that counts and is replaced in one rename, so readers see
    the rows of one publication with its manifest, or those of the one before.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{out}/{name}/data")
    full = manifest | {"rows": spark.read.parquet(f"{out}/{name}/data").count()}
    fs, path = _file_system(spark, out)
    _put(spark, fs, path(f"{out}/{name}/manifest.json"), json.dumps(full, ensure_ascii=False, indent=1, sort_keys=True))
    staged = path(f"{out}/.current-{name}")
    _put(spark, fs, staged, name)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context.rename(staged, path(f"{out}/current"), options)
    return full


def read_pair(spark: SparkSession, out: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest that count."""
    name = spark.read.text(f"{out}/current").first()["value"]
    manifest = "\n".join(r["value"] for r in spark.read.text(f"{out}/{name}/manifest.json", wholetext=True).collect())
    return spark.read.parquet(f"{out}/{name}/data"), json.loads(manifest)


def _file_system(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(where).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _put(spark: SparkSession, fs, path, text: str) -> None:
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def manifest_digest(path: str) -> str:
    """SHA-256 of a file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; bars are escaped. A table of more than ``most`` rows is refused, not cut."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows; this is for small tables")
    rows = [df.columns, ["---"] * len(df.columns), *found]
    return "\n".join("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)


def _tags(row, labels: Sequence[str], *more: str) -> str:
    escaped = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    parts = [*(f'{x}="{escaped(row[x])}"' for x in labels), *more]
    return "{" + ",".join(parts) + "}" if parts else ""


def _sorted(df: DataFrame, labels: Sequence[str]) -> list:
    """One row per series."""
    return (df.orderBy(*labels) if labels else df).collect()


def samples(df: DataFrame, name: str, value: str, labels: Sequence[str] = (), kind: str = "counter") -> str:
    """A counter or gauge, one sample per row, in the text format of metrics servers."""
    return "\n".join([f"# TYPE {name} {kind}", *(f"{name}{_tags(r, labels)} {r[value]}" for r in _sorted(df, labels))])


def summary(df: DataFrame, name: str, value: str, labels: Sequence[str] = ()) -> str:
    """Sum and count of a column per series."""
    each = df.where(F.col(value).isNotNull()).groupBy(*labels).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return "\n".join([f"# TYPE {name} summary", *(f"{name}_{k}{_tags(r, labels)} {r[c]}" for r in _sorted(each, labels) for k, c in (("sum", "s"), ("count", "n")))])


def exposition(histogram: DataFrame, name: str, labels: Sequence[str] = (), sums: DataFrame | None = None) -> str:
    """A cumulative histogram (labels, le, n) in the text format of metrics servers; ``sums`` has (labels, s, n) of each series."""
    lines = [f"# TYPE {name} histogram"]
    for r in histogram.orderBy(*labels, F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.expr("try_cast(le as double)"))).collect():
        le = f'le="{r["le"]}"'
        lines.append(f"{name}_bucket{_tags(r, labels, le)} {r['n']}")
    for r in _sorted(sums, labels) if sums is not None else ():
        lines += [f"{name}_sum{_tags(r, labels)} {r['s']}", f"{name}_count{_tags(r, labels)} {r['n']}"]
    return "\n".join(lines)
