"""Writers of a run's frames: tables, CSV, flowcharts, load and extraction scripts, a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stable import numbered, stable
from ..operators.jobs import JOB_COLUMNS

CHUNK, MISSING, SHOWN = 500, 999, 50
# Colours of the classes in a flowchart; the literals and INSERT statements of ``quoted`` and ``load_script`` are a fixed form, too.
STYLE = {"ROOT": "fill:#e3f2fd,stroke:#1565c0", "TERMINAL": "fill:#e8f5e9,stroke:#2e7d32", "INTERMEDIATE": "fill:#fff8e1,stroke:#f9a825", "ISOLATED": "fill:#eeeeee,stroke:#757575"}


def save_run(frames: dict[str, DataFrame], path: str, run_id: int) -> None:
    """Write every frame below ``path`` as the partition of its run, which it replaces."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")


def save_csv(frames: dict[str, DataFrame], path: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True, quote='"', escape='"')


def quoted(c: Column) -> Column:
    """A SQL literal: q'[...]', or a plain string where the text holds its end mark."""
    return F.when(c.isNull(), "null").when(~F.contains(c, F.lit("]'")), F.concat(F.lit("q'["), c, F.lit("]'"))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def load_script(jobs: DataFrame, table: str = "book_jobs") -> DataFrame:
    """(job_num, statement): an INSERT for each job."""
    text = [quoted(F.col(c)) for c in JOB_COLUMNS[1:6]]
    sql = F.when(F.col("sql_stmt").isNull(), "null").otherwise(F.concat(F.lit("to_clob("), quoted(F.col("sql_stmt")), F.lit(")")))
    values = F.concat_ws(", ", F.col("job_num").cast("string"), *text, sql, quoted(F.col("disabled_flag")))
    return jobs.select("job_num", F.concat(F.lit(f"insert into {table} ({', '.join(JOB_COLUMNS)}) values (\n  "), values, F.lit(");")).alias("statement"))


def _within(df: DataFrame, name: str, *order: str) -> DataFrame:
    """The place of each row within its group: its place among all rows, less that of the group's first."""
    n, _ = numbered(df, "group_name", *order, name="_n")
    return n.join(stable(n.groupBy("group_name").agg(F.min("_n").alias("_first"))), "group_name").withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def flowcharts(edges: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_name, line_no, line): a flowchart for each group of jobs; node ids are the same in all of them.

    Ids follow the first use of a node over the groups in order, edges in the order of job, source and target.
    Lines stay rows, so no group is gathered in one value.
    """
    e = edges.filter("job_num is not null and is_self_loop = 'N'").join(groups.select("job_num", "group_name"), "job_num", "left")
    e = _within(e.withColumn("group_name", F.coalesce("group_name", F.lit("(no group)"))), "e", "job_num", "source_node", "target_node", "ref_context")
    ends = e.select("group_name", "e", F.posexplode(F.array("source_node", "target_node")).alias("side", "node")).groupBy("group_name", "node").agg(F.min(F.struct("e", "side")).alias("first"))
    firsts = ends.groupBy("node").agg(F.min(F.struct("group_name", "first")).alias("o"))
    ids = numbered(firsts, "o", name="id", start=0)[0].select("node", F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    named = ends.join(ids, "node")
    heads = e.select("group_name").distinct().select("group_name", F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).alias("k"), F.lit("").alias("n")).alias("o"), F.lit("flowchart LR").alias("line"))
    boxes = named.select("group_name", F.struct(F.col("first.e").alias("e"), F.col("first.side").alias("k"), F.lit("").alias("n")).alias("o"), F.concat(F.lit("  "), "id", F.lit('["'), "node", F.lit('"]')).alias("line"))
    arrow = F.when(F.col("ref_context") == "FILTER", "-.->").otherwise("-->")
    a = e.join(ids.withColumnRenamed("node", "source_node").withColumnRenamed("id", "a"), "source_node").join(ids.withColumnRenamed("node", "target_node").withColumnRenamed("id", "b"), "target_node")
    arrows = a.select("group_name", F.struct(F.col("e"), F.lit(2).alias("k"), F.lit("").alias("n")).alias("o"), F.concat(F.lit("  "), "a", F.lit(" "), arrow, F.lit("|"), F.col("job_num").cast("string"), F.lit(" "), "action_type", F.lit("| "), "b").alias("line"))
    colour = F.create_map(*[F.lit(x) for kv in STYLE.items() for x in kv])
    st = named.join(nodes.select(F.col("node_name").alias("node"), F.element_at(colour, F.col("job_node_class")).alias("style")), "node").filter("style is not null")
    styles = st.select("group_name", F.struct(F.lit(2**62).alias("e"), F.lit(3).alias("k"), F.col("node").alias("n")).alias("o"), F.concat(F.lit("  style "), "id", F.lit(" "), "style").alias("line"))
    every = heads.unionByName(boxes).unionByName(arrows).unionByName(styles)
    return _within(every, "line_no", "o").select("group_name", "line_no", "line")


#: What the extraction script asks of the catalogue: settings of the client, then of the generated DDL.
CLIENT = ("define off", "long 2000000", "longchunksize 32767", "pagesize 0", "linesize 32767", "trimspool on")
DDL_SETTINGS = ("SQLTERMINATOR", "PRETTY")


def _listed(names: list[str]) -> str:
    return ", ".join(quoted_name(n) for n in names) or "null"


def quoted_name(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def _statement(columns: str, table: str, conditions: list[str], order: str | None = None) -> str:
    text = f"select {columns} from {table}"
    if conditions:
        text += " where " + " and ".join(conditions)
    return text + (f" order by {order};" if order else ";")


def view_script(names: list[str], owner: str | None = None) -> str:
    """A script for a database client that fetches the definitions of the named views, statement by statement.

    A catalogue takes so many names in a list, so one query is made for each chunk of them. The
    check for missing views and the commented portable variant name a bounded number.
    """
    of = quoted_name(owner.upper()) if owner else "sys_context('USERENV', 'CURRENT_SCHEMA')"
    out = [f"-- {len(names)} views", *(f"set {x}" for x in CLIENT)]
    out += [f"exec dbms_metadata.set_transform_param(dbms_metadata.session_transform, '{x}', true);" for x in DDL_SETTINGS]
    for i in range(0, max(len(names), 1), CHUNK):
        among = [f"owner = {of}", f"view_name in ({_listed(names[i : i + CHUNK])})"]
        out.append(_statement("owner, view_name, text_length, text_vc", "all_views", among, "view_name"))
        out.append(_statement("dbms_metadata.get_ddl('VIEW', view_name, owner) as ddl", "all_views", among, "view_name"))
    known = _statement("1", "all_views a", [f"a.owner = {of}", "a.view_name = v.column_value"]).rstrip(";")
    out.append(_statement("v.column_value as missing_view", f"table(sys.odcivarchar2list({_listed(names[:MISSING])})) v", [f"not exists ({known})"]))
    out.append("-- " + _statement("table_schema, table_name, view_definition", "information_schema.views", [f"table_name in ({_listed(names[:SHOWN])}{', ...' if len(names) > SHOWN else ''})"]))
    return "\n".join(out) + "\n"


def view_script_lines(views: DataFrame, owner: str | None = None) -> DataFrame:
    """(line) of the extraction script for views (node_name), of which a catalogue holds a bounded number of names."""
    names = sorted(r[0] for r in views.distinct().toLocalIterator())
    return views.sparkSession.createDataFrame([(x,) for x in view_script(names, owner).splitlines()], "line string").coalesce(1)


def summary(jobs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, n): counts of jobs, nodes, edges, classes and nodes in cycles."""
    one = lambda df, item: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), "n")
    out = one(jobs, "jobs").union(one(jobs.filter("is_active = 'Y'"), "active jobs")).union(one(nodes, "nodes")).union(one(edges, "edges")).union(one(nodes.filter("in_cycle = 'Y'"), "nodes in cycles"))
    return out.union(nodes.groupBy("node_class").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("class "), "node_class"), "n"))
