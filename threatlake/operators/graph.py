"""Process and network graph: edges, nodes and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .severity import RANK
from .shared import Scratch

#: Rounds after which a walk is given up with an error.
MOST_ROUNDS = 10_000


def _network(events: DataFrame) -> DataFrame:
    connects = events.where("destination_ip <> '' and (event_id in ('3', '5156') or event_category = 'network_connection')")
    return connects.withColumn("target", F.concat(F.lit("net-"), "destination_ip", F.lit(":"), F.coalesce("destination_port", F.lit(""))))


def edges(events: DataFrame) -> DataFrame:
    """Distinct spawn and connect edges, with the label and number of the first event."""
    spawn = events.where("parent_process_guid <> process_guid").select(
        F.col("parent_process_guid").alias("source"), F.col("process_guid").alias("target"), F.lit("SPAWNED").alias("type"), F.col("process_name").alias("label"), "seq")
    net = _network(events).select(F.col("process_guid").alias("source"), "target", F.lit("CONNECTED").alias("type"), F.col("destination_port").alias("label"), "seq")
    return spawn.unionByName(net).groupBy("source", "target", "type").agg(F.min_by("label", "seq").alias("label"), F.min("seq").alias("first_seq"))


def nodes(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Processes with the attributes of their first event and what their findings say, parents
    that have no event of their own, and network ends."""
    place = F.col("seq")
    own = events.where("process_guid <> ''").groupBy(F.col("process_guid").alias("id")).agg(
        F.min_by(F.struct(F.col("process_name").alias("label"), "hostname", "user_name", "commandline"), place).alias("f"), F.count("*").alias("events"), F.min("seq").alias("first_seq"))
    own = own.select("id", F.lit("process").alias("type"), "f.*", "events", "first_seq")
    parents = events.where("parent_process_guid <> '' and (process_guid is null or parent_process_guid <> process_guid)").groupBy(F.col("parent_process_guid").alias("id")).agg(
        F.min_by(F.struct(F.col("parent_process_name").alias("label"), "hostname"), place).alias("f"), F.min("seq").alias("first_seq"))
    parents = parents.join(own.select("id"), "id", "left_anti").select("id", F.lit("process").alias("type"), "f.*", F.lit(0).cast("long").alias("events"), "first_seq")
    ends = _network(events).groupBy(F.col("target").alias("id")).agg(F.min_by("hostname", place).alias("hostname"), F.count("*").alias("events"), F.min("seq").alias("first_seq"))
    ends = ends.select("id", F.lit("network").alias("type"), F.regexp_replace("id", "^net-", "").alias("label"), "hostname", "events", "first_seq")
    marks = findings.groupBy(F.col("process_guid").alias("id")).agg(
        F.max(F.expr(RANK)).alias("severity_rank"), F.array_join(F.array_sort(F.collect_set("rule_id")), "|").alias("rules"), F.array_join(F.array_sort(F.collect_set("mitre")), "|").alias("techniques"))
    out = own.unionByName(parents, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True).join(marks, "id", "left")
    return out.withColumns({"severity_rank": F.coalesce("severity_rank", F.lit(0)), "rules": F.coalesce("rules", F.lit("")), "techniques": F.coalesce("techniques", F.lit(""))})


def top(node: DataFrame, edge: DataFrame, most: int = 500) -> DataFrame:
    """The `most` most severe nodes, then by first event, and one level of their parents."""
    kept = node.orderBy(F.desc("severity_rank"), "first_seq", "id").limit(most).select("id")
    parents = edge.join(kept.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).join(node.select("id"), "id", "left_semi")
    return node.join(kept.union(parents).distinct(), "id", "left_semi")


def top_edges(shown: DataFrame, edge: DataFrame, most: int | None = 2_000) -> DataFrame:
    """Edges between displayed nodes (see top), the first `most` by their first event if given."""
    ids = shown.select("id")
    inner = edge.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    inner = inner.select("source", "target", "type", "label", "first_seq")
    return inner.orderBy("first_seq", "source", "target", "type").limit(most) if most else inner


def stats(node: DataFrame, edge: DataFrame, most: int | None = None, most_edges: int = 2_000) -> DataFrame:
    """Counts of the graph, of its edges between displayed nodes, and of the severities of the
    nodes displayed (see top); truncated: not all nodes, or not all of these edges, are shown."""
    shown = Scratch(node.sparkSession, "shown").keep(top(node, edge, most) if most else node, "nodes")
    inner = top_edges(shown, edge, None).agg(F.count("*").alias("_inner"))
    levels = [F.count_if(F.col("severity_rank") == r).alias(n) for r, n in ((4, "critical"), (3, "high"), (2, "medium"))]
    of_edges = edge.agg(F.count("*").alias("edges"), F.count_if(F.expr("type = 'SPAWNED'")).alias("spawned"), F.count_if(F.expr("type = 'CONNECTED'")).alias("connected"))
    whole = node.agg(F.count("*").alias("nodes")).crossJoin(shown.agg(F.count("*").alias("displayed"), *levels)).crossJoin(of_edges).crossJoin(inner)
    cut = (F.col("displayed") < F.col("nodes")) | (F.col("_inner") > most_edges)
    return whole.withColumns({"displayed_edges": F.least("_inner", F.lit(most_edges)), "truncated": cut}).drop("_inner")


def _all(rounds: list[DataFrame]) -> DataFrame:
    """The rows of all rounds written so far, as one scan."""
    files = [f for r in rounds for f in r.inputFiles()]
    return rounds[0].sparkSession.read.schema(rounds[0].schema).parquet(*files) if files else rounds[0]


def first_parents(edge: DataFrame) -> DataFrame:
    """(node, parent): the parent of a process's first spawn edge; of equal ones the least."""
    order = F.struct(*(c for c in ("first_seq", "source") if c in edge.columns))
    return edge.where("type = 'SPAWNED'").groupBy(F.col("target").alias("node")).agg(F.min_by("source", order).alias("parent"))


def tree(edge: DataFrame, paths: bool = True, most_rounds: int | None = None) -> DataFrame:
    """Every process of a spawn edge once: root, node, parent, depth, path, children, on_cycle.

    The tree is that of first parents. Pointers double: after k rounds a node knows its
    ancestor 2^k steps up, or its root, so a chain of n takes log2(n) rounds of one join each;
    a node whose pointer still moves after that lies on a cycle or below one: root, depth and
    path are null and on_cycle is true. path runs from the root to the node (None with
    paths=False: paths of a long chain grow with the square of its length). children is
    their number; they are the rows that name the node as parent. Rounds are written, and
    what has met its root is not written again.
    """
    spark = edge.sparkSession
    scratch = Scratch(spark, "tree")
    up = scratch.keep(first_parents(edge), "parents")
    tops = up.select(F.col("parent").alias("node")).distinct().join(up.select("node"), "node", "left_anti")
    below = up.select(F.col("node").alias("parent")).withColumn("_inner", F.lit(True))
    step = F.array("parent") if paths else F.lit(None).cast("array<string>")
    now = scratch.keep(up.join(below, "parent", "left").select("node", F.col("parent").alias("top"), F.lit(1).alias("depth"), step.alias("path"), F.col("_inner").isNull().alias("done")), "0")
    settled, moving = now.where("done"), now.where("not done")
    for k in range(1, up.count().bit_length() + 1):
        if moving.isEmpty():
            break
        if most_rounds and k > most_rounds:
            raise RuntimeError(f"the tree did not end in {most_rounds} rounds")
        known = settled.unionByName(moving).select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("done").alias("_done"))
        path = F.concat("_path", "path") if paths else F.col("path")
        then = moving.join(known, "top").select("node", F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"), path.alias("path"), F.col("_done").alias("done"))
        then = scratch.keep(then, str(k))
        settled, moving = settled.unionByName(then.where("done")), then.where("not done")
    own = F.array("node") if paths else F.lit(None).cast("array<string>")
    roots = tops.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), own.alias("path"), F.lit(False).alias("on_cycle"))
    found = settled.select(F.col("top").alias("root"), "node", "depth", (F.concat("path", F.array("node")) if paths else F.col("path")).alias("path"), F.lit(False).alias("on_cycle"))
    lost = moving.select(F.lit(None).cast("string").alias("root"), "node", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(True).alias("on_cycle"))
    children = up.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    rows = roots.unionByName(found).unionByName(lost).join(up, "node", "left").join(children, "node", "left")
    return rows.select("root", "node", "parent", "depth", "path", F.coalesce("children", F.lit(0)).alias("children"), "on_cycle")


def ego(edge: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched nodes (column node) and all that one edge, either way, connects with them."""
    near = [edge.join(matched.select(F.col("node").alias(a)), a, "left_semi").select(F.col(b).alias("node")) for a, b in (("source", "target"), ("target", "source"))]
    return matched.select("node").union(near[0]).union(near[1]).distinct()


def with_ancestors(edge: DataFrame, matched: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Matched nodes (column node), all their ancestors, and one level of children of these.

    A round walks up only from nodes that are new, so cycles end. Rounds are written to the
    shared folder until one is empty; raises after most_rounds.
    """
    scratch = Scratch(edge.sparkSession, "walk")
    spawn = scratch.keep(edge.where("type = 'SPAWNED'").select("source", "target").distinct(), "spawn")
    front = scratch.keep(matched.select("node").distinct(), "0")
    rounds = [front]
    for k in range(1, most_rounds + 1):
        up = spawn.join(front.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")).distinct()
        front = scratch.keep(up.join(_all(rounds), "node", "left_anti"), str(k))
        if front.isEmpty():
            seen = _all(rounds)
            children = spawn.join(seen.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node"))
            return seen.unionByName(children).distinct()
        rounds.append(front)
    raise RuntimeError(f"ancestors did not end in {most_rounds} rounds")
