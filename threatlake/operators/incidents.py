"""Incidents: findings of one host linked by user, process or time, as connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .severity import RANK, priority
from .shared import Scratch, components as connected

#: States of an incident that is no longer open.
CLOSED = ("remediated", "excluded", "risk_accepted")
#: Findings that a narrative names.
STEPS = 8


def gap_sessions(rows: DataFrame, seconds: int = 3600, key: str = "hostname", bucket_seconds: int = 86_400) -> DataFrame:
    """Adds `session`: the seq of its first row; rows of a key chain while gaps are at most `seconds`.

    Rows are ordered inside time buckets, so a key with very many rows is spread over tasks; a
    bucket's first and last row then tell whether its first session goes on from the one before.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.where("ts is not null").withColumn("_b", F.floor(micros / F.lit(bucket_seconds * 1_000_000)))
    order = W.partitionBy(key, "_b").orderBy("ts", "seq")
    gap = micros - F.lag(micros).over(order)
    begin = F.when(gap.isNull() | (gap > seconds * 1_000_000), F.col("seq"))
    local = rows.withColumn("session", F.last(begin, True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    place = F.struct("ts", "seq")
    ends = local.groupBy(key, "_b").agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"), F.min_by("session", place).alias("_first"), F.max_by("session", place).alias("last"))
    across = W.partitionBy(key).orderBy("_b")
    goes_on = F.coalesce(F.col("lo") - F.lag("hi").over(across) <= seconds * 1_000_000, F.lit(False))
    ends = ends.withColumn("goes_on", goes_on)
    source = F.when(F.col("last") != F.col("_first"), F.col("last")).when(~F.col("goes_on"), F.col("_first"))
    ends = ends.withColumn("tail", F.last(source, True).over(across.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.when(F.col("goes_on"), F.lag("tail").over(across)).otherwise(F.col("_first"))
    ends = ends.select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), "_first", whole.alias("_whole"))
    joined = local.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")))
    session = F.when(F.col("session") == F.col("_first"), F.col("_whole")).otherwise(F.col("session"))
    return joined.select(*(c for c in rows.columns if c != "_b"), session.alias("session"))


def components(findings: DataFrame, seconds: int = 3600) -> DataFrame:
    """Adds `incident`, the least seq of the component.

    Findings meet at hyper-nodes (host and session, host and user, host and process), never
    in pairs.
    """
    scratch = Scratch(findings.sparkSession, "incidents")
    findings = scratch.keep(findings, "findings")  # read several times below
    timed = gap_sessions(findings, seconds).select("seq", "rule_ord", "session")
    rows = findings.join(timed, ["seq", "rule_ord"], "left")
    host = F.coalesce("hostname", F.lit(""))
    own = F.concat_ws("\x01", F.lit("e"), F.col("seq").cast("string"))
    edges = rows.select("seq", own.alias("a"), F.explode(F.array(
        F.when(F.col("session").isNotNull(), F.concat_ws("\x01", F.lit("s"), host, F.col("session").cast("string"))),
        F.when(F.col("user_name") != "", F.concat_ws("\x01", F.lit("u"), host, "user_name")),
        F.when(F.col("process_guid") != "", F.concat_ws("\x01", F.lit("g"), host, "process_guid")),
    )).alias("b")).where("b is not null")
    edges = scratch.keep(edges.distinct(), "edges")
    roots = connected(edges, scratch, "round")
    placed = edges.select("seq", F.col("a").alias("node")).distinct().join(roots, "node", "left").select("seq", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("seq").alias("incident"))
    found = placed.join(least, "root").select("seq", "incident")
    return scratch.keep(findings.join(found, "seq", "left").withColumn("incident", F.coalesce("incident", "seq")), "labelled")


#: What is kept between runs: the root of every node, and the first and last time of every
#: host and span of time.
NODES, SPANS = "node string, root string", "hostname string, span long, lo long, hi long"


def advance(findings: DataFrame, nodes: DataFrame, spans: DataFrame, scratch: Scratch, seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(nodes, spans) after new findings, from those before (empty tables of NODES, SPANS at first).

    Links are those of components(): in spans of `seconds` all findings of a host chain, and
    two neighbouring spans do where the last time of one is near the first of the next. New
    findings can only add links, so their edges are contracted to the roots of the nodes they
    touch, components of these few roots are found, and only nodes of roots that gave way
    change. A new finding is a leaf: what it links is linked directly, so that the rounds see
    users, processes and spans but no findings, and its root is that of the least of these. What is returned are the rows to keep; changed() gives those that differ.
    """
    host = F.coalesce("hostname", F.lit(""))
    micros, width = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    rows = findings.select("seq", host.alias("hostname"), "user_name", "process_guid", micros.alias("at")).withColumn("span", F.floor(F.col("at") / width))
    timed = rows.where("at is not null").groupBy("hostname", "span").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    fresh = scratch.keep(timed, "fresh-spans")
    spans = scratch.keep(spans.unionByName(fresh).groupBy("hostname", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "spans")

    def of_span(number: Column) -> Column:
        return F.concat_ws("\x01", F.lit("t"), F.col("hostname"), number.cast("string"))

    own = F.concat_ws("\x01", F.lit("e"), F.col("seq").cast("string"))
    mine = rows.select(own.alias("a"), F.explode(F.array(
        own, F.when(F.col("span").isNotNull(), of_span(F.col("span"))),
        F.when(F.col("user_name") != "", F.concat_ws("\x01", F.lit("u"), "hostname", "user_name")),
        F.when(F.col("process_guid") != "", F.concat_ws("\x01", F.lit("g"), "hostname", "process_guid")),
    )).alias("b")).where("b is not null")
    touched = fresh.select("hostname", F.explode(F.array(F.col("span") - 1, F.col("span"))).alias("span")).distinct()
    left = spans.join(touched, ["hostname", "span"], "left_semi")
    right = spans.select("hostname", (F.col("span") - 1).alias("span"), F.col("lo").alias("next"))
    chained = left.join(right, ["hostname", "span"]).where(F.col("next") - F.col("hi") <= width)
    edges = scratch.keep(mine.union(chained.select(of_span(F.col("span")), of_span(F.col("span") + 1))).distinct(), "new-edges")
    known = nodes.join(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    known = scratch.keep(known, "known")
    contracted = edges
    for end in ("a", "b"):
        found = known.select(F.col("node").alias(end), F.col("root").alias("_r"))
        contracted = contracted.join(found, end, "left").withColumn(f"_new_{end}", F.col("_r").isNull()).withColumn(end, F.coalesce("_r", end)).drop("_r")
    contracted = scratch.keep(contracted.select("a", "b", (F.col("_new_a") & F.col("a").startswith("e\x01")).alias("leaf")), "links")
    leaves = contracted.where("leaf and a <> b").select("a", "b", F.min("b").over(W.partitionBy("a")).alias("m"))
    leaves = scratch.keep(leaves, "leaves")
    links = leaves.select(F.col("m").alias("a"), "b").union(contracted.where("not leaf").select("a", "b"))
    moved = connected(links, scratch, "contracted").select(F.col("node").alias("_n"), F.col("root").alias("_to"))
    fresh_nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node"), "node", "left_anti")
    fresh_nodes = fresh_nodes.join(leaves.select(F.col("a").alias("node"), "m").distinct(), "node", "left").select("node", F.coalesce("m", "node").alias("root"))
    every = nodes.select("node", "root").unionByName(fresh_nodes)
    out = every.join(moved, every["root"] == moved["_n"], "left").select("node", F.coalesce("_to", "root").alias("root"))
    return scratch.keep(out, "nodes"), spans


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The nodes whose root is new or another than before."""
    return after.join(before.select("node", F.col("root").alias("_was")), "node", "left").where(~F.col("root").eqNullSafe(F.col("_was"))).select("node", "root")


def placed(nodes: DataFrame) -> DataFrame:
    """(seq, incident) of kept nodes: the incident is the least seq under a root."""
    own = nodes.where(F.col("node").startswith("e\x01")).select(F.expr("cast(substr(node, 3) as bigint)").alias("seq"), "root")
    return own.join(own.groupBy("root").agg(F.min("seq").alias("incident")), "root").select("seq", "incident")


def follow(log: DataFrame, where: DataFrame) -> DataFrame:
    """Triage of incidents that may have merged since: it goes to the incident that now holds
    the finding by which the old one was numbered (where: seq, incident)."""
    now = where.select(F.col("seq").alias("incident_id"), "incident")
    return log.join(now, "incident_id", "left").withColumn("incident_id", F.coalesce("incident", "incident_id")).drop("incident")


def _key(*more: Column) -> Column:
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("rule_id", "hostname", "user_name", "process_guid")]
    return F.concat_ws("|", *text, F.substring(F.coalesce("commandline", F.lit("")), 1, 120), *more)


def finding_key() -> Column:
    """A stable id of a finding within its incident."""
    return F.concat(F.lit("f_"), F.substring(F.sha1(_key(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))), 1, 14))


def rollup(labelled: DataFrame) -> DataFrame:
    """Per incident: id, title, severity, priority, counts, sets as sorted text, times, narrative.

    The id is a sum of the findings' hashes, so it is the same whenever the same findings come
    again, in any order, and no incident's findings are gathered. The narrative names the
    first STEPS findings and how many more there are.
    """
    place = F.struct("seq", "rule_ord")
    digest = F.conv(F.substring(F.md5(_key()), 1, 15), 16, 10).cast("decimal(38,0)")

    def names(column: str, out: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col(column) != "", F.col(column)))), "|").alias(out)

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column) != "", place))

    out = labelled.groupBy("incident").agg(
        F.concat(F.lit("inc_"), F.sum(digest).cast("string")).alias("id"), F.max(F.greatest(F.expr(RANK), F.lit(1))).alias("severity_rank"), F.count("*").alias("finding_count"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), names("hostname", "hosts"), names("user_name", "users"), names("tactic", "tactics"),
        names("mitre", "tactic_ids"), names("rule_id", "rule_ids"), first("tactic").alias("_tactic"), first("hostname").alias("_host"), first("process_name").alias("_process"),
    )
    ranked = labelled.withColumn("_n", F.row_number().over(W.partitionBy("incident").orderBy(F.asc_nulls_last("ts"), "seq", "rule_ord"))).where(F.col("_n") <= STEPS)
    step = F.concat(F.lit("["), F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit("] "), "rule_name")
    told = ranked.groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", step.alias("s")))), lambda x: x["s"]).alias("_steps"))
    more = F.when(F.col("finding_count") > STEPS, F.concat(F.lit(" (+"), (F.col("finding_count") - STEPS).cast("string"), F.lit(" more)"))).otherwise("")
    title = F.concat(
        F.coalesce("_tactic", F.lit("Suspicious activity")), F.lit(" on "), F.coalesce("_host", F.lit("unknown host")),
        F.coalesce(F.concat(F.lit(" via "), "_process"), F.lit("")),
    )
    out = out.join(told, "incident").withColumns({"title": title, "narrative": F.concat(F.array_join("_steps", " → "), more), "priority": priority(F.col("severity_rank"))})
    return out.drop("_tactic", "_host", "_process", "_steps")


def ranked(incidents: DataFrame) -> DataFrame:
    """The most severe first, then those of most findings, then by number."""
    return incidents.orderBy(F.desc("severity_rank"), F.desc("finding_count"), "incident")


def stats(incidents: DataFrame) -> DataFrame:
    """Total, open and closed incidents, and the open ones by priority, of merged incidents."""
    open_ = ~F.lower(F.coalesce("status", F.lit("new"))).isin(*CLOSED)
    by = [F.count_if(open_ & (F.col("priority") == p)).alias(p.lower()) for p in ("P0", "P1", "P2", "P3")]
    return incidents.agg(F.count("*").alias("total"), F.count_if(open_).alias("open"), F.count_if(~open_).alias("closed"), *by)


def latest_triage(log: DataFrame) -> DataFrame:
    """Partial updates folded to the last value given of each field."""
    fields = [c for c in log.columns if c not in ("incident_id", "seq")]
    return log.groupBy("incident_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields))


def triage_merge(incidents: DataFrame, log: DataFrame, key: str = "incident") -> DataFrame:
    """Incidents with their stored state, or the defaults; a stored priority replaces the suggested one."""
    fields = [c for c in log.columns if c not in ("incident_id", "seq")]
    state = latest_triage(log).select("incident_id", *(F.col(c).alias(f"_{c}") for c in fields))
    joined = incidents.join(state, F.col(key) == F.col("incident_id"), "left").drop("incident_id")
    out = {c: F.coalesce(f"_{c}", F.lit("new") if c == "status" else F.col(c) if c in incidents.columns else F.lit("")) for c in fields}
    return joined.withColumns(out).drop(*(f"_{c}" for c in fields))
