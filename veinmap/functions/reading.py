"""The SQL reader over a DataFrame of statements, and over single texts from SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import name_of, owner_of
from .sqltext import analyze, tokenize
from .sqltext.analyze import LINEAGE_COLUMNS, TREE_COLUMNS, tidy_name

_REF = pa.struct([("object_name", pa.string()), ("object_role", pa.string()), ("ref_context", pa.string())])
_LINEAGE = pa.struct([(c, pa.int32() if c == "column_pos" else pa.string()) for c in LINEAGE_COLUMNS])
_TREE = pa.struct([(c, pa.int32() if c in ("node_id", "parent_id", "start_pos", "end_pos", "depth", "sibling_seq") else pa.string()) for c in TREE_COLUMNS])
_FIELDS = [("status", pa.string()), ("message", pa.string()), ("statement", pa.string()), ("target", pa.string()), ("tokens", pa.int32()), ("refs", pa.list_(_REF)), ("lineage", pa.list_(_LINEAGE)), ("tree", pa.list_(_TREE))]
_SCHEMA = (
    "id string, status string, message string, statement string, target string, tokens int, refs array<struct<object_name:string,object_role:string,ref_context:string>>, "
    "lineage array<struct<target_column:string,column_pos:int,expression:string,transform_type:string,source_object:string,source_column:string,ref_role:string,resolution:string>>, "
    "tree array<struct<node_id:int,parent_id:int,node_type:string,node_name:string,node_text:string,start_pos:int,end_pos:int,depth:int,sibling_seq:int>>"
)


def _struct(names: tuple[str, ...], rows: list[tuple]) -> list[dict]:
    return [dict(zip(names, r, strict=True)) for r in rows]


def read_statements(statements: DataFrame, tree: bool = True) -> DataFrame:
    """(id, status, message, statement, target, tokens, refs, lineage, tree) of rows (id, sql, target, owner, columns).

    ``columns`` maps the names of tables to their columns (see ``with_dictionary``), so that no task
    needs the whole dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, got = b.column("id").to_pylist(), []
            for sql, target, owner, known in zip(*(b.column(c).to_pylist() for c in ("sql", "target", "owner", "columns")), strict=True):
                table = {k: list(v) for k, v in known or []}
                a = analyze(sql, target, owner, lambda t, table=table: table.get(t, []), tree)
                got.append((a.status, a.message, a.statement, a.target, a.tokens, _struct(("object_name", "object_role", "ref_context"), a.refs), _struct(LINEAGE_COLUMNS, a.lineage), _struct(TREE_COLUMNS, a.tree)))
            cols = list(zip(*got, strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True))], ["id", *(n for n, _ in _FIELDS)])

    return statements.select("id", "sql", "target", "owner", "columns").mapInArrow(run, _SCHEMA)


def texts_of(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text) of rows (id, sql, target, owner), and each different text once as (id, sql, target, owner) with its digest as id.

    What reading gives follows from these three columns and the dictionary, so that equal statements need one reading.
    """
    text = F.sha2(F.to_json(F.struct("sql", "target", "owner")), 256)  # nulls are left out, so they differ from empty texts
    return statements.select("id", text.alias("text")), statements.select(text.alias("id"), "sql", "target", "owner").distinct()


def names_in(sql: str) -> set[str]:
    """Names of one and two parts, as they are read, that the tokens of a text form."""
    out, before, dot = set(), None, False
    for t in tokenize(sql):
        if t.kind in ("ID", "QID"):
            out.add(t.name)
            if dot and before is not None:
                out.add(f"{before}.{t.name}")
            before, dot = t.name, False
        else:
            dot = t.kind == "."
            before = before if dot else None
    return out


def table_names(statements: DataFrame) -> DataFrame:
    """(id, owner, name) of every name, of one or two parts, that may be a table's in a statement, and of its target: the text's tokens, without parsing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, sql, target, owner in zip(*(b.column(c).to_pylist() for c in ("id", "sql", "target", "owner")), strict=True):
                own = f"{owner.upper()}." if owner else "."
                names = names_in(sql or "") | {n for n in (target, tidy_name(target)) if n}
                rows += [(key, owner, n) for n in sorted({n.removeprefix(own) for n in names})]
            k, o, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(o, pa.string()), pa.array(n, pa.string())], ["id", "owner", "name"])

    return statements.select("id", "sql", "target", "owner").mapInArrow(run, "id string, owner string, name string")


def columns_of(names: DataFrame, columns: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(owner, name, cols) for rows (owner, name): the table's own columns, else those behind the owner's synonym, else behind a public one."""
    wanted = names.select("owner", "name").distinct().filter(~F.contains("name", F.lit("@")))
    wanted = wanted.withColumn("o", F.coalesce(owner_of(F.col("name")), "owner")).withColumn("t", name_of(F.col("name")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("column_id", "column_name"))), lambda x: x["column_name"])
    tables = columns.groupBy(F.col("owner").alias("o"), F.col("table_name").alias("t")).agg(ordered.alias("cols"))
    found = wanted.join(tables, ["o", "t"]).withColumn("rank", F.lit(1))
    if synonyms is not None:
        behind = synonyms.filter("db_link is null").select(F.col("owner").alias("so"), F.col("synonym_name").alias("t"), F.col("table_owner").alias("to"), F.col("table_name").alias("tt"))
        behind = behind.join(tables.select(F.col("o").alias("to"), F.col("t").alias("tt"), "cols"), ["to", "tt"]).select("so", "t", "cols")
        own = wanted.join(behind.withColumnRenamed("so", "o"), ["o", "t"]).withColumn("rank", F.lit(2))
        public = wanted.join(behind.filter("so = 'PUBLIC'").drop("so"), "t").withColumn("rank", F.lit(3))
        found = found.unionByName(own).unionByName(public.select(*own.columns))
    return found.groupBy("owner", "name").agg(F.min_by("cols", "rank").alias("cols"))


def with_dictionary(statements: DataFrame, columns: DataFrame | None, synonyms: DataFrame | None = None) -> DataFrame:
    """Adds ``columns``, a map from the tables that each statement names to their columns: joins, no broadcast dictionary."""
    if columns is None:
        return statements.withColumn("columns", F.lit(None).cast("map<string,array<string>>"))
    names = table_names(statements)
    known = names.join(columns_of(names, columns, synonyms), ["owner", "name"])
    maps = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "cols"))).alias("columns"))
    return statements.join(maps, "id", "left")


class Tokens:
    """Table function: the tokens of one text."""

    def eval(self, sql: str):
        for n, t in enumerate(tokenize(sql or ""), 1):
            yield n, t.kind, t.text, t.start, t.end


class ParseTree:
    """Table function: the syntax tree of one text."""

    def eval(self, sql: str):
        yield from analyze(sql).tree


class ColumnLineage:
    """Table function: the column lineage of one text that defines ``target``."""

    def eval(self, sql: str, target: str):
        yield from analyze(sql, target, tree=False).lineage


def register_functions(spark: SparkSession) -> None:
    """Table functions ``sql_tokens``, ``sql_parse_tree`` and ``sql_column_lineage``, and the SQL function ``is_disabled``."""
    spark.udtf.register("sql_tokens", F.udtf(Tokens, returnType="token_no int, token_type string, token_text string, start_pos int, end_pos int"))
    spark.udtf.register("sql_parse_tree", F.udtf(ParseTree, returnType="node_id int, parent_id int, node_type string, node_name string, node_text string, start_pos int, end_pos int, depth int, sibling_seq int"))
    spark.udtf.register("sql_column_lineage", F.udtf(ColumnLineage, returnType="target_column string, column_pos int, expression string, transform_type string, source_object string, source_column string, ref_role string, resolution string"))
    from .rules import DISABLED

    marks = ", ".join(f"'{m}'" for m in DISABLED)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_disabled(flag STRING) RETURNS STRING RETURN CASE WHEN upper(trim(flag)) IN ({marks}) THEN 'Y' ELSE 'N' END")
