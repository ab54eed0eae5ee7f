"""Readers of job tables and view definitions."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import clean_cell, filled
from ..functions.sqltext import tokenize
from ..operators.jobs import JOB_COLUMNS

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _jobs(df: DataFrame) -> DataFrame:
    """Upper- or lower-case headers to job columns; cells cleaned; rows without a job number dropped; sorted."""
    names = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    missing = [c for c in JOB_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df.select(*[clean_cell(F.col(f"`{names[c]}`")).alias(c) for c in JOB_COLUMNS])
    return out.withColumn("job_num", F.expr("try_cast(job_num as bigint)")).filter("job_num is not null").orderBy("job_num")


def read_jobs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A job table in CSV with quoted, possibly multi-line fields; header in any case, byte-order mark allowed."""
    return _jobs(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8"))


def read_jobs_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _jobs(spark.read.parquet(path))


def _cells(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet of a workbook."""
    import io

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheet = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", _NS):
                at = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A1")).group():
                    at = at * 26 + ord(letter) - 64
                v = c.find("m:v", _NS)
                if c.get("t") == "s" and v is not None:
                    cells[at - 1] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    cells[at - 1] = v.text if v is not None else None
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def read_jobs_workbook(spark: SparkSession, path: str) -> DataFrame:
    """A job table in the first sheet of an .xlsx workbook (a format of about a million rows at most): header row first, blank rows passed by."""
    from pyspark.sql.types import StringType, StructField, StructType

    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    head, *body = _cells(bytes(data))
    width = len(head)
    fields = StructType([StructField(str(h), StringType()) for h in head])
    return _jobs(spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in body if any(r)], fields))


def load_into_table(jobs: DataFrame, name: str, truncate: bool = True) -> None:
    """Put a job table into a table of the catalogue, made if it isn't there; ``truncate`` empties it first."""
    _table_name(name)
    jobs.write.mode("overwrite" if truncate else "append").saveAsTable(name)


def jobs_of_script(statements: DataFrame) -> DataFrame:
    """The jobs of INSERT statements (statement) as ``load_script`` writes them: literals in the order of the job columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [literals(s) for s in b.column("statement").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(JOB_COLUMNS)})

    return _jobs(statements.select("statement").mapInArrow(run, ", ".join(f"{c} string" for c in JOB_COLUMNS)))


def literals(statement: str) -> list[str | None]:
    """Values of an INSERT, as many as there are job columns."""
    out: list[str | None] = []
    tokens = tokenize(statement)
    start = next((i for i, t in enumerate(tokens) if t.key == "VALUES"), len(tokens))
    for t in tokens[start:]:
        if t.kind == "STR":
            quoted = t.text[0] in "qQ"
            out.append(t.text[3:-2] if quoted else t.text[1:-1].replace("''", "'"))
        elif t.kind == "NUM" or t.key == "NULL":
            out.append(t.text if t.kind == "NUM" else None)
    return (out + [None] * len(JOB_COLUMNS))[: len(JOB_COLUMNS)]


def read_views_csv(spark: SparkSession, path: str) -> DataFrame:
    """(owner, view_name, text) from a CSV export whose text column is TEXT or VIEW_TEXT."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", maxCharsPerColumn=-1)
    names = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    text = [F.col(f"`{names[c]}`") for c in ("text", "view_text") if c in names]
    owner = F.col(f"`{names['owner']}`") if "owner" in names else F.lit(None).cast("string")
    return df.select(filled(F.upper(F.trim(owner))).alias("owner"), F.upper(F.trim(f"`{names['view_name']}`")).alias("view_name"), F.coalesce(*text).alias("text")).filter("view_name is not null")


def _table_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][\w$#]*(\.[A-Za-z_][\w$#]*){0,2}", name):
        raise ValueError(f"not a table name: {name}")
    return name


def read_jobs_table(spark: SparkSession, name: str) -> DataFrame:
    """A job table of the catalogue; the name is checked to be one."""
    return spark.table(_table_name(name))


def catalog_columns(spark: SparkSession, database: str) -> DataFrame:
    """(owner, table_name, column_name, column_id) of a database of Spark's own catalogue."""
    rows = [(database.upper(), t.name.upper(), c.name.upper(), i) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1)]
    return spark.createDataFrame(rows, "owner string, table_name string, column_name string, column_id int")
