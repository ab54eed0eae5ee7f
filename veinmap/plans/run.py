"""A whole run: jobs, view definitions and a column dictionary in, the lineage model out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.reading import read_statements, with_dictionary
from ..functions.stable import stable
from ..operators import columns as C
from ..operators import deps, graph, jobs, trace, views


@dataclass
class Lineage:
    """Frames of one run, each computed when it is first asked for.

    views (owner, view_name, text); columns (owner, table_name, column_name, column_id); synonyms (owner, synonym_name, table_owner,
    table_name, db_link); objects (owner, object_name, object_type); dependencies (owner, name, type, referenced_owner,
    referenced_name, referenced_type, referenced_link_name). All but the jobs are optional. ``owner`` is the schema that plain
    names belong to: the session's current one unless given.
    """

    source: DataFrame
    views: DataFrame | None = None
    columns: DataFrame | None = None
    synonyms: DataFrame | None = None
    objects: DataFrame | None = None
    dependencies: DataFrame | None = None
    owner: str | None = None
    label: str | None = None
    run_id: int = 1
    capture_views: bool = True
    view_depth: int = 25
    use_dependencies: bool = True
    save_ast: bool = True
    driver_edges: int = graph.DRIVER_EDGES

    def __post_init__(self) -> None:
        self.owner = (self.owner or self.source.sparkSession.catalog.currentDatabase()).upper()
        self.started = datetime.now(timezone.utc)

    @cached_property
    def loaded(self) -> DataFrame:
        return stable(jobs.load_jobs(self.source))

    @cached_property
    def groups(self) -> DataFrame:
        return jobs.job_groups(self.loaded)

    @cached_property
    def statements(self) -> DataFrame:
        s = jobs.job_statements(self.loaded, self.owner)
        if self.views is not None and self.capture_views:
            s = s.unionByName(views.view_statements(self.views, self.owner))
        return s

    @cached_property
    def read(self) -> DataFrame:
        """Every statement, read once; the frames below take their parts of it."""
        s = self.statements
        asked = s.filter("dictionary")
        plain = s.filter("not dictionary").withColumn("columns", F.lit(None).cast("map<string,array<string>>"))
        every = with_dictionary(asked, self.columns, self.synonyms).unionByName(plain) if self.columns is not None else s.withColumn("columns", F.lit(None).cast("map<string,array<string>>"))
        return stable(read_statements(every, self.save_ast))

    @cached_property
    def jobs(self) -> DataFrame:
        known = jobs.classified_jobs(self.loaded, self.read, self.owner)
        cols = ["case_type", "action_type", "load_key", "parse_status", "parse_message"]
        return self.loaded.join(known.select("job_num", *cols), "job_num", "left")

    @cached_property
    def _classified(self) -> DataFrame:
        return stable(jobs.classified_jobs(self.loaded, self.read, self.owner).drop("sql_stmt"))

    @cached_property
    def job_objects(self) -> DataFrame:
        return stable(jobs.job_objects(self._classified))

    @cached_property
    def job_edges(self) -> DataFrame:
        return stable(jobs.job_edges(self._classified))

    @cached_property
    def captured(self) -> DataFrame | None:
        if self.views is None or not self.capture_views:
            return None
        o = self.job_objects.filter("object_role in ('SOURCE', 'TARGET')").select(F.col("object_name").alias("name"))
        starts = self.job_edges.select(F.explode(F.array("source_node", "target_node")).alias("name")).union(o)
        return stable(views.capture(starts, self.views, self._view_refs, self._depends, self.owner, self.view_depth))

    @cached_property
    def _view_refs(self) -> DataFrame:
        return stable(views.view_refs(self.read, self.statements, self.owner))

    @cached_property
    def _depends(self) -> DataFrame | None:
        return views.dependency_sources(self.dependencies, self.owner) if self.dependencies is not None and self.use_dependencies else None

    @cached_property
    def edges(self) -> DataFrame:
        if self.captured is None:
            return self.job_edges
        return stable(self.job_edges.unionByName(views.view_edges(self.captured, self._view_refs, self._depends, self.statements)))

    @cached_property
    def parses(self) -> DataFrame:
        """(id, source_kind, job_num, object_name, status, message, statement, token_count, ast_nodes) of what was read and counts."""
        job = F.when(F.col("id").startswith("J"), F.substring("id", 2, 20).cast("long"))
        r = self.read.filter("id not like 'F%'").select("id", job.alias("job_num"), "status", "message", "statement", F.col("tokens").alias("token_count"), F.size("tree").alias("ast_nodes"))
        s = self.statements.select("id", F.col("target").alias("view"), F.col("sql").alias("sql_text"))
        tgt = self.loaded.select("job_num", R.norm(F.col("target_object"), self.owner).alias("tgt"))
        r = r.join(s, "id").join(tgt, "job_num", "left")
        if self.captured is not None:
            r = r.join(self.captured.select("id", F.lit(True).alias("seen")), "id", "left").filter("job_num is not null or seen").drop("seen")
        return r.select("id", F.when(F.col("job_num").isNotNull(), "JOB_SQL").otherwise("VIEW").alias("source_kind"), "job_num", F.coalesce("tgt", "view").alias("object_name"), "status", "message", "statement", "token_count", "ast_nodes", "sql_text")

    @cached_property
    def ast(self) -> DataFrame:
        kept = self.parses.select("id", "object_name")
        return self.read.select("id", F.explode("tree").alias("n")).join(kept, "id").select("id", "object_name", "n.*")

    @cached_property
    def column_lineage(self) -> DataFrame:
        p = self.parses
        origin = F.when(F.col("source_kind") == "VIEW", "VIEW_DEF").otherwise("JOB_SQL")
        own = C.read_lineage(self.read, p.select("id", "job_num", "object_name", origin.alias("lineage_origin")))
        return stable(own.unionByName(C.standard_lineage(self.jobs, self.job_objects, self.columns, self.owner)))

    @cached_property
    def nodes(self) -> DataFrame:
        return stable(graph.nodes(self.edges, self.job_objects, self.objects, self.captured, self.owner, self.driver_edges))

    @cached_property
    def job_deps(self) -> DataFrame:
        return stable(deps.job_dependencies(self.job_objects, self.loaded, self.edges, self.groups))

    @cached_property
    def group_edges(self) -> DataFrame:
        return jobs.group_edges(self.edges, self.groups)

    def trace_object(self, name: str, direction: str = "UPSTREAM", max_depth: int = trace.OBJECT_DEPTH) -> DataFrame:
        return trace.trace_object(self.edges, name, direction, max_depth)

    def trace_column(self, name: str, column: str, direction: str = "UPSTREAM", max_depth: int = trace.COLUMN_DEPTH) -> DataFrame:
        return trace.trace_column(self.column_lineage, name, column, direction, max_depth)

    def frames(self) -> dict[str, DataFrame]:
        out = {"jobs": self.jobs, "job_groups": self.groups, "job_objects": self.job_objects, "edges": self.edges, "nodes": self.nodes, "job_deps": self.job_deps, "column_lineage": self.column_lineage, "parses": self.parses}
        if self.save_ast:
            out["ast"] = self.ast
        if self.captured is not None:
            out["view_ddl"] = self.captured
        return out

    def run_row(self, status: str = "COMPLETED", message: str | None = None) -> DataFrame:
        """The run's own row: label, status, times and counts (nulls for a run that failed)."""
        spark = self.source.sparkSession
        counts = [None] * 8
        if status == "COMPLETED":
            read = F.col("parse_status")
            j = self.jobs.agg(F.count(F.lit(1)), F.count_if(F.col("is_active") == "Y"), F.count_if(read.isin("OK", "PARTIAL")), F.count_if(read == "FALLBACK")).first()
            v = self.captured.count() if self.captured is not None else 0
            counts = [j[0], j[1], j[0] - j[1], j[2], j[3], v, self.nodes.count(), self.edges.count()]
        finished = None if status == "RUNNING" else datetime.now(timezone.utc)
        row = (self.run_id, self.label, status, message, self.started, finished, *counts)
        return spark.createDataFrame([row], "run_id long, run_label string, status string, message string, started_at timestamp, finished_at timestamp, rows_read long, rows_active long, rows_disabled long, sql_parsed long, sql_fallback long, views_captured long, node_count long, edge_count long")


def build(source: DataFrame, **options) -> Lineage:
    """A run over a job table; see ``Lineage`` for the options."""
    return Lineage(source, **options)
