"""Graph operators: nodes, degrees, classes, strongly connected components and levels.

Every walk is a loop of joins over frames that are written between the steps. Components of graphs up
to ``DRIVER_EDGES`` edges (counted first; a fixed bound of a few tens of MB) may be found on the driver; larger ones
are found in joins only, by doubled steps along nodes with one way out or in, trimming and colouring.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.stable import stable

DRIVER_EDGES = 500_000


def graph_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self loops."""
    return edges.filter("is_self_loop = 'N'").select(F.col("source_node").alias("src"), F.col("target_node").alias("dst")).distinct()


def node_names(edges: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    out = edges.select(F.explode(F.array("source_node", "target_node")).alias("node_name"))
    if objects is not None:
        out = out.union(objects.select("object_name"))
    return out.filter("node_name is not null").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node_name, in_degree, out_degree, job_in_degree, job_out_degree): distinct neighbours, self loops left out."""
    e = edges.filter("is_self_loop = 'N'")
    by_job = lambda other: F.countDistinct(F.when(F.col("job_num").isNotNull(), F.col(other)))
    outs = e.groupBy(F.col("source_node").alias("node_name")).agg(F.countDistinct("target_node").alias("out_degree"), by_job("target_node").alias("job_out_degree"))
    ins = e.groupBy(F.col("target_node").alias("node_name")).agg(F.countDistinct("source_node").alias("in_degree"), by_job("source_node").alias("job_in_degree"))
    return ins.join(outs, "node_name", "full_outer").na.fill(0)


def job_use(objects: DataFrame) -> DataFrame:
    """(node_name, writer_jobs, reader_jobs, first_writer_job, last_writer_job)."""
    wrote, read = F.when(F.col("object_role") == "TARGET", F.col("job_num")), F.when(F.col("object_role") == "SOURCE", F.col("job_num"))
    return objects.groupBy(F.col("object_name").alias("node_name")).agg(F.countDistinct(wrote).alias("writer_jobs"), F.countDistinct(read).alias("reader_jobs"), F.min(wrote).alias("first_writer_job"), F.max(wrote).alias("last_writer_job"))


def node_types(names: DataFrame, objects: DataFrame | None, dictionary: DataFrame | None, owner: str | None) -> DataFrame:
    """(node_name, node_type, type_source): procedures that are called, names that are no identifiers, the dictionary, else a guess."""
    n = names
    if objects is not None:
        n = n.join(objects.filter("object_role = 'CALL'").select(F.col("object_name").alias("node_name"), F.lit(True).alias("_call")).distinct(), "node_name", "left")
    else:
        n = n.withColumn("_call", F.lit(None).cast("boolean"))
    if dictionary is not None:
        order = F.when(F.col("object_type") == "MATERIALIZED VIEW", 1).when(F.col("object_type") == "TABLE", 2).when(F.col("object_type") == "VIEW", 3).otherwise(4)
        known = dictionary.filter("object_type in ('TABLE', 'VIEW', 'MATERIALIZED VIEW', 'SYNONYM')").groupBy(F.col("owner").alias("_o"), F.col("object_name").alias("_t")).agg(F.min_by("object_type", order).alias("_type"))
        n = n.withColumn("_o", R.owner_of(F.col("node_name"), owner)).withColumn("_t", R.name_of(F.col("node_name"))).join(known, ["_o", "_t"], "left")
    else:
        n = n.withColumn("_type", F.lit(None).cast("string"))
    odd = ~F.col("node_name").rlike(R.IDENTIFIER)
    kind = F.when(F.col("_call"), "PROCEDURE").when(odd, "PSEUDO").when(F.col("_type").isNotNull(), F.col("_type")).when(F.col("node_name").rlike("_V$"), "VIEW").otherwise("TABLE")
    source = F.when(F.col("_call").isNull() & ~odd & F.col("_type").isNotNull(), "DICTIONARY").otherwise("HEURISTIC")
    return n.select("node_name", kind.alias("node_type"), source.alias("type_source"))


def job_node_class(writers: Column, readers: Column, ins: Column, outs: Column) -> Column:
    return F.when((writers + readers == 0) & (ins + outs == 0), "VIEW_ONLY").otherwise(R.node_class(ins, outs))


# -- strongly connected components
def _tarjan(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Least member of the component of every node, without recursion."""
    onward: dict[str, list[str]] = {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
        onward.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    root: dict[str, str] = {}
    stack: list[str] = []
    for start in sorted(onward):
        if start in number:
            continue
        trail = [(start, iter(onward[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        while trail:
            node, rest = trail[-1]
            nxt = next((n for n in rest if n not in root), None)
            if nxt is None:
                trail.pop()
                if low[node] == number[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    root |= dict.fromkeys(members, min(members))
                elif trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
            elif nxt in number:
                low[node] = min(low[node], number[nxt])
            else:
                number[nxt] = low[nxt] = len(number)
                stack.append(nxt)
                trail.append((nxt, iter(onward[nxt])))
    return root


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, color): the least node from which each node of the edges (src, dst) is reached, itself included.

    A node takes the least colour of its predecessors, then that of its own colour (what reaches the colour reaches the
    node), so that rounds don't grow with the length of paths.
    """
    color = stable(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("color", F.col("node")))
    while True:
        least = edges.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("c"))
        hop = stable(color.join(least, "node", "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color"), F.col("color").alias("old")))
        jump = hop.select(F.col("node").alias("color"), F.col("color").alias("c"))
        nxt = stable(hop.join(jump, "color").select("node", F.least("color", "c").alias("color"), (F.least("color", "c") < F.col("old")).alias("moved")))
        color = nxt.select("node", "color")
        if nxt.filter("moved").isEmpty():
            return color


def components_by_colour(edges: DataFrame) -> DataFrame:
    """(node, root) by joins alone: peel nodes without incoming or outgoing edges; colour the rest by the least node that reaches
    them; what reaches back to that node within its colour is its component; repeat on what is left."""
    e, done = _distinct(edges), []
    every = stable(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    before = e.count()
    while before:
        while True:  # peel
            both = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            e = stable(e.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            n, before = before, e.count()
            if before in (0, n):
                break
        if not before:
            break
        color = _least_reaching(e)
        inner = e.join(color.withColumnRenamed("node", "src"), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c")), "dst").filter("color = c")
        # within a colour its own node is the least, so whoever reaches it has it as the least node on the way back
        back = _least_reaching(stable(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        members = stable(back.join(color.withColumnRenamed("color", "root"), "node").filter("color = root").select("node", "root"))
        done.append(members)
        gone = members.select("node")
        e = stable(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        before = e.count()
    out = every.withColumn("root", F.lit(None).cast(every.schema["node"].dataType))
    for members in done:
        out = out.join(members.withColumnRenamed("root", "r"), "node", "left").select("node", F.coalesce("root", "r").alias("root"))
    return out.select("node", F.coalesce("root", "node").alias("root"))


def _rings(pointers: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (node, to), one row a node, from which the pointers lead back, and the least node of their ring.

    Steps double: a round keeps the nodes that a step ends at, until a step only permutes what is left; then the least node of
    2, 4, 8, ... steps is taken until a doubling lowers none. Rounds grow with the logarithm of the longest path.
    """
    state = stable(pointers.select("node", F.col("to").alias("at"), F.col("node").alias("root")))
    n = state.count()
    while n:
        kept = stable(state.join(state.select(F.col("at").alias("node")).distinct(), "node", "left_semi"))
        if kept.count() == n:
            break
        state = stable(kept.join(_onward(state), "at").select("node", F.col("to").alias("at"), F.least("root", "other").alias("root")))
        n = state.count()
    while n:
        state = stable(state.join(_onward(state), "at").select("node", F.col("to").alias("at"), F.least("root", "other").alias("root"), (F.col("other") < F.col("root")).alias("moved")))
        if state.filter("moved").isEmpty():
            break
    return state.select("node", "root")


def _onward(state: DataFrame) -> DataFrame:
    return state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("root").alias("other"))


def _ends(pointers: DataFrame) -> list[DataFrame]:
    """(node, at) after 1, 2, 4, ... steps along pointers without rings; a step past the last pointer stays there. All have ended in the last."""
    steps = [stable(pointers.select("node", F.col("to").alias("at")))]
    while True:
        s = steps[-1]
        nxt = stable(s.join(s.select(F.col("node").alias("at"), F.col("at").alias("to")), "at", "left").select("node", F.coalesce("to", "at").alias("at"), F.col("to").isNotNull().alias("moved")))
        if nxt.filter("moved").isEmpty():
            return steps
        steps.append(nxt.select("node", "at"))


def _without_single_exits(e: DataFrame, out: DataFrame) -> DataFrame:
    """``_in_components`` of edges (src, dst) whose sources ``out`` (src, n, to) mostly have one way out.

    Such nodes lead into a ring, which is a component; to a node without exits, so that they are in none; or to a node with several
    exits, whose graph is what is left to be solved. They are of that node's component if its members lead to them.
    """
    pointers = out.filter("n = 1").select(F.col("src").alias("node"), "to")
    rings = stable(_rings(pointers))
    split = stable(out.filter("n > 1").select(F.col("src").alias("node")))
    if split.isEmpty():
        return rings
    steps = _ends(pointers.join(rings, "node", "left_anti"))
    ends = stable(steps[-1].join(split.withColumnRenamed("node", "at"), "at", "left_semi").select("node", "at"))
    way = e.join(split.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", F.coalesce("at", "dst").alias("to"))
    way = stable(way.join(split.withColumnRenamed("node", "to"), "to", "left_semi").select("src", "dst", "to"))
    inner = _in_components(stable(way.filter("src <> to").select("src", F.col("to").alias("dst")).distinct()))
    part = stable(split.join(inner, "node", "left").select("node", F.coalesce("root", "node").alias("part")))
    entered = way.filter("dst <> to").join(part.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(part.select(F.col("node").alias("to"), F.col("part").alias("b")), "to").filter("a = b")
    within = stable(entered.select(F.col("dst").alias("node")).distinct())
    for step in steps:  # what 1, 2, 4, ... steps from there pass
        passed = step.join(within, "node").select(F.col("at").alias("node")).join(ends, "node", "left_semi")
        within = stable(within.unionByName(passed).distinct())
    members = stable(within.join(ends, "node").join(part.select(F.col("node").alias("at"), "part"), "at").select("node", "part").unionByName(part))
    roots = members.groupBy("part").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rings.unionByName(members.join(roots, "part").select("node", "root"))


def _in_components(e: DataFrame) -> DataFrame:
    """(node, root) of the nodes in components of several nodes, of distinct written edges (src, dst) without self loops.

    Where a quarter of the sources has one way out, or of the targets one way in, these are taken out first by doubled steps: peeling and
    colouring take a round for each edge of a long path, and these paths would be walked one by one.
    """
    for a, b in (("src", "dst"), ("dst", "src")):
        turned = e.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        out = stable(turned.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")))
        n = out.count()
        if not n:
            return e.select(F.col("src").alias("node"), F.col("src").alias("root"))
        if 4 * out.filter("n = 1").count() >= n:
            return _without_single_exits(turned, out)
    away = components_by_colour(e).filter("node <> root")
    return away.unionByName(away.select(F.col("root").alias("node"), "root").distinct())


def components_by_joins(edges: DataFrame) -> DataFrame:
    """(node, root) by joins alone: nodes with one way out or in by doubled steps, what is left by peeling and colouring."""
    e = _distinct(edges)
    every = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return every.join(stable(_in_components(e)), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _distinct(edges: DataFrame) -> DataFrame:
    return stable(edges.select("src", "dst").filter("src <> dst").distinct())


def _pairs(e: DataFrame, at_most: int) -> list[tuple[str, str]] | None:
    """The edges of a written table on the driver, None if there are more than a fixed number of them (counted first)."""
    if not at_most or e.count() > at_most:
        return None
    t = e.toArrow()
    return list(zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True))


def strong_components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root): the least node of each node's strongly connected component."""
    e = _distinct(edges)
    pairs = _pairs(e, driver_edges)
    if pairs is None:
        return components_by_joins(e)
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(sorted(_tarjan(pairs).items()), f"node {kind}, root {kind}")


def cycles(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root): the nodes in cycles with the least node of their component; no levels, which take a round for each."""
    e = _distinct(edges)
    pairs = _pairs(e, driver_edges)
    if pairs is None:
        return _in_components(e)
    root = _tarjan(pairs)
    size = Counter(root.values())
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(sorted((n, r) for n, r in root.items() if size[r] > 1), f"node {kind}, root {kind}")


def _peel(e: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels (node, dag_level) of what isn't in or behind a cycle of the edges (src, dst), and the edges that are left.

    A round takes the nodes without incoming edges away with their edges, so an edge is read until it goes and never again.
    """
    front = stable(every.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node"))
    parts, step = [front.withColumn("dag_level", F.lit(0))], 0
    while not front.isEmpty():
        step += 1
        marked = stable(e.join(front.select(F.col("node").alias("src"), F.lit(True).alias("gone")), "src", "left").select("src", "dst", F.coalesce("gone", F.lit(False)).alias("gone")))
        e = marked.filter("not gone").select("src", "dst")
        front = stable(marked.groupBy(F.col("dst").alias("node")).agg(F.bool_and("gone").alias("free")).filter("free").select("node"))
        parts.append(front.withColumn("dag_level", F.lit(step)))
        if len(parts) == 32:
            parts = [stable(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts), e


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, dag_level, in_cycle): longest path over the components, all members of a component on one level."""
    of = stable(roots)
    e = edges.join(of.select(F.col("node").alias("src"), F.col("root").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    level, _ = _peel(stable(e), of.select(F.col("root").alias("node")).distinct())
    sizes = of.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return of.join(level.withColumnRenamed("node", "root"), "root").join(sizes, "root").select("node", "root", "dag_level", F.when(F.col("size") > 1, "Y").otherwise("N").alias("in_cycle"))


def _levels_here(pairs: list[tuple[str, str]], root: dict[str, str]) -> dict[str, int]:
    """Longest path to each component, over the components in the order of a peel."""
    e = {(root[a], root[b]) for a, b in pairs if root[a] != root[b]}
    onward: dict[str, list[str]] = {}
    waits = dict.fromkeys(root.values(), 0)
    for a, b in e:
        onward.setdefault(a, []).append(b)
        waits[b] += 1
    level = dict.fromkeys(waits, 0)
    ready = [r for r, n in waits.items() if not n]
    for r in ready:
        for b in onward.get(r, ()):
            level[b] = max(level[b], level[r] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return level


def places(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root, dag_level, in_cycle) of a graph: on the driver up to a fixed number of edges, else by joins.

    A graph without cycles is done by one peel; components are looked for only if that leaves edges.
    """
    e = _distinct(edges)
    pairs = _pairs(e, driver_edges)
    kind = edges.schema["src"].dataType.simpleString()
    if pairs is not None:
        root = _tarjan(pairs)
        level, size = _levels_here(pairs, root), Counter(root.values())
        names = list(root)
        t = pa.table({"node": pa.array(names), "root": pa.array([root[n] for n in names]), "dag_level": pa.array([level[root[n]] for n in names], pa.int32()), "in_cycle": pa.array(["Y" if size[root[n]] > 1 else "N" for n in names], pa.string())})
        return edges.sparkSession.createDataFrame(t).select(F.col("node").cast(kind), F.col("root").cast(kind), "dag_level", "in_cycle")
    level, left = _peel(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    if left.isEmpty():
        return level.select("node", F.col("node").alias("root"), "dag_level", F.lit("N").alias("in_cycle"))
    return levels(e, components_by_joins(e))


def nodes(edges: DataFrame, objects: DataFrame, dictionary: DataFrame | None = None, captured: DataFrame | None = None, owner: str | None = None, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """One row per node with type, degrees, use by jobs, classes, level and cycle flag."""
    names = node_names(edges, objects)
    g = stable(graph_edges(edges))
    place = places(g, driver_edges).select(F.col("node").alias("node_name"), "dag_level", "in_cycle")
    n = node_types(names, objects, dictionary, owner).join(degrees(edges), "node_name", "left").join(job_use(objects), "node_name", "left").join(place, "node_name", "left")
    n = n.na.fill(0, ["in_degree", "out_degree", "job_in_degree", "job_out_degree", "writer_jobs", "reader_jobs", "dag_level"]).na.fill("N", ["in_cycle"])
    if captured is not None:
        name = F.when(F.col("owner").eqNullSafe(F.lit(owner)), F.col("view_name")).otherwise(F.concat_ws(".", "owner", "view_name"))
        n = n.join(captured.select(name.alias("node_name"), F.lit("Y").alias("view_captured")).distinct(), "node_name", "left").na.fill("N", ["view_captured"])
    else:
        n = n.withColumn("view_captured", F.lit("N"))
    return n.withColumn("node_class", R.node_class(F.col("in_degree"), F.col("out_degree"))).withColumn("job_node_class", job_node_class(F.col("writer_jobs"), F.col("reader_jobs"), F.col("job_in_degree"), F.col("job_out_degree")))
