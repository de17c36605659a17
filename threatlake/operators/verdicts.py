"""Verdicts on events and findings: replication rights, exclusions, session summary, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.schema import Field, against, defaults
from .severity import RANK, priority

#: Extended rights that directory replication asks for.
REPLICATION_RIGHTS = {
    "1131f6aa-9c07-11d1-f79f-00c04fc2dcd2": "DS-Replication-Get-Changes",
    "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2": "DS-Replication-Get-Changes-All",
    "89e95b76-444d-4c62-991a-0facbeda640c": "DS-Replication-Get-Changes-In-Filtered-Set",
}
#: Fixed value: the form of a technique.
TECHNIQUE = r"^T\d{4}(\.\d{3})?$"
KEY_FINDINGS = 8


def replication_right(text: Column) -> Column:
    """The first replication right whose id a text holds, null if none."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(guid)), F.lit(name)) for guid, name in REPLICATION_RIGHTS.items()))


def used_right(text: Column, events: DataFrame) -> Column:
    """The replication right that an event uses, null if none: named in its text, or by a 4662's
    properties or object. Columns that the events lack count as null."""
    is_4662 = F.coalesce(F.col("event_id") == "4662", F.lit(False))
    properties, thing = (F.col(c) if c in events.columns else F.lit(None).cast("string") for c in ("properties", "object_guid"))
    named = F.when(is_4662 & F.contains(F.lower(properties), F.lit("replication")), properties)
    listed = F.when(is_4662, replication_right(F.concat_ws(" ", properties, thing)))
    return F.coalesce(replication_right(text), named, listed)


def replication_rights(events: DataFrame) -> DataFrame:
    """Events that use a replication right."""
    found = used_right(F.col("commandline"), events)
    return events.select("seq", "hostname", "user_name", found.alias("matched_right"), F.lit(10).alias("severity")).where("matched_right is not null")


def replication_signs(right: Column, user: Column) -> Column:
    """What a verdict on a used replication right says."""
    actor = F.concat(F.lit("Actor: "), F.coalesce(user, F.lit("unknown")), F.lit(" (should be a DC machine account)"))
    return F.array(F.concat(F.lit("AD Replication right: "), right), F.lit("EID 4662 triggered by non-DC account"), actor)


def exclude_findings(findings: DataFrame, excluded: DataFrame, key: tuple[str, ...] = ("seq", "rule_id")) -> DataFrame:
    """Per incident its counts, and severity and priority of the findings not excluded; with
    none of those left the old severity stays. excluded: incident and key columns."""
    marks = excluded.select("incident", *key).distinct().withColumn("_out", F.lit(True))
    rows = findings.join(marks, ["incident", *key], "left")
    active, rank = F.col("_out").isNull(), F.expr(RANK)
    out = rows.groupBy("incident").agg(
        F.count("*").alias("finding_count"), F.count_if(active).alias("active_finding_count"),
        F.coalesce(F.max(F.when(active, rank)), F.max(rank)).alias("severity_rank"),
    )
    return out.withColumns({"all_excluded": F.col("active_finding_count") == 0, "priority": priority(F.col("severity_rank"))})


def session_summary(findings: DataFrame, most_names: int | None = None, key_findings: int = KEY_FINDINGS) -> DataFrame:
    """The report on a session as rows (item, ord, value); without findings the severity is clean.

    most_names: names of a kind at most, in order (None: all); key_findings: findings that the
    report quotes.
    """
    rank = F.expr(RANK)
    level = F.max(F.greatest(rank, F.lit(1)))
    totals = findings.agg(
        F.element_at(F.array(*map(F.lit, ("clean", "low", "medium", "high", "critical"))), F.coalesce(level, F.lit(0)) + 1).alias("overall_severity"),
        F.coalesce(F.max(F.when(F.col("tactic") != "", F.col("tactic"))), F.when(F.count("*") == 0, "None").otherwise("Unknown")).alias("attack_stage"),
        F.count("*").cast("string").alias("findings"), F.count_if(F.upper("severity") == "CRITICAL").cast("string").alias("critical"),
    )
    out = totals.unpivot([], totals.columns, "item", "value").select("item", F.lit(1).alias("ord"), "value")
    for item, column in (("host", "hostname"), ("user", "user_name")):
        names = findings.where(F.col(column) != "").select(F.col(column).alias("value")).distinct()
        names = names.orderBy("value").limit(most_names) if most_names else names
        out = out.union(names.select(F.lit(item), F.lit(1), "value"))
    last = findings.where(F.col("mitre").rlike(TECHNIQUE)).groupBy("mitre").agg(F.max_by("rule_name", F.struct("seq", "rule_ord")).alias("rule"))
    out = out.union(last.select(F.concat(F.lit("technique "), "mitre"), F.lit(1), "rule"))
    top = findings.withColumn("_rank", rank).orderBy(F.desc("_rank"), "seq", "rule_ord").limit(key_findings)
    text = F.concat("rule_name", F.lit(" on "), F.coalesce("hostname", F.lit("")), F.lit(" by "), F.coalesce("user_name", F.lit("")))
    return out.union(top.select(F.lit("key finding"), F.row_number().over(W.orderBy(F.desc("_rank"), "seq", "rule_ord")), text))


def export_feedback(labels: DataFrame, path: str, deidentify: bool = False) -> None:
    """Labelled rows as JSON lines; de-identified ones lack analyst, context and trust."""
    (labels.drop("analyst", "context", "trust") if deidentify else labels).write.json(path)


def feedback(rows: DataFrame, trusted: list[str]) -> DataFrame:
    """Analyst feedback with its id, label, trust and bounded severity.

    rows: commandline, process_name, event_id, hostname, agree, verdict (what was said before),
    corrected (null: no correction), corrected_severity, analyst. A correction is the label;
    else the verdict, turned round where the analyst disagrees.
    """
    context = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in ("commandline", "process_name", "event_id", "hostname")))
    return rows.withColumns({
        "id": F.concat(F.lit("fb_"), F.substring(F.sha1(context), 1, 16)),
        "label": F.coalesce("corrected", F.when(F.col("agree"), F.col("verdict")).otherwise(~F.col("verdict"))),
        "trust": F.when(F.col("analyst").isin(trusted), 1.0).otherwise(0.5),
        "corrected_severity": F.least(F.greatest("corrected_severity", F.lit(1)), F.lit(10)),
    })


def disputed(feedback: DataFrame, least_trust: float = 0.9) -> DataFrame:
    """Ids whose trusted labels disagree."""
    labels = feedback.where((F.col("trust") >= least_trust) & F.col("label").isNotNull())
    return labels.groupBy("id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("id")


def floor(verdicts: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Verdicts from elsewhere, never below the heuristic severity; techniques and indicators united."""
    ours = scored.select(key, F.col("severity").alias("_s"), F.col("techniques").alias("_t"), F.col("indicators").alias("_i"))
    joined = verdicts.join(ours, key, "left")
    none = F.array().cast("array<string>")
    raised = F.coalesce(F.col("_s") > F.col("severity"), F.lit(False))
    return joined.withColumns({
        "severity": F.greatest("severity", F.coalesce("_s", F.lit(1))), "is_malicious": F.when(raised, F.col("_s") >= 5).otherwise(F.col("is_malicious")),
        "techniques": F.array_union("techniques", F.coalesce("_t", none)), "indicators": F.array_union("indicators", F.coalesce("_i", none)),
    }).drop("_s", "_t", "_i")


#: The forms of a verdict on an event and of a report on a session, with their bounds.
EVENT_FORM = (
    Field("severity", "int", 1, 1, 10),
    Field("is_malicious", "bool", False),
    Field("mitre_techniques", "list", (), longest=128, most=2**31 - 1, pattern=r"T\d{4}(\.\d{3})?"),
    Field("indicators", "list", (), longest=512, most=50, null_item=""),
    Field("intent", default="", longest=4096),
    Field("decoded", default=None, longest=8192),
    Field("recommendation", default="", longest=4096),
)
SESSION_FORM = (
    Field("overall_severity", "enum", "clean", values=("critical", "high", "medium", "low", "clean"), lower=True),
    Field("attack_stage", "enum", "Unknown", values=(
        "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement",
        "Collection", "Exfiltration", "Command and Control", "Multi-Stage", "Unknown", "None",
    )),
    Field("executive_summary", default="", longest=2000),
    Field("attack_narrative", default="", longest=6000),
    Field("affected_hosts", "list", (), longest=200, most=100, null_item=""),
    Field("affected_users", "list", (), longest=200, most=100, null_item=""),
    Field("techniques_used", "dicts", (), most=30, drop=True, fields=(
        Field("id", longest=128, pattern=r"T\d{4}(\.\d{3})?"), Field("name", default="", longest=200), Field("description", default="", longest=1000),
    )),
    Field("key_findings", "list", (), longest=1000, most=50, null_item=""),
    Field("immediate_actions", "list", (), longest=200, most=50, null_item=""),
    Field("threat_actor_profile", default="Unknown", longest=1000, null=""),
)
#: Techniques of a verdict at most.
MOST_TECHNIQUES = 20


def validate(rows: DataFrame, column: str = "json") -> DataFrame:
    """Checked fields of verdicts on events that come as JSON (EVENT_FORM), errors, source and valid.

    valid is false, and the fields are the defaults, where the text is no JSON object or its
    severity is given but is no number; techniques of the wrong form are left out.
    """
    found = rows.withColumn("_r", against(EVENT_FORM, F.col(column)))
    said = F.try_variant_get(F.try_parse_json(F.coalesce(F.col(column), F.lit(""))), "$.severity", "variant")
    no_number = F.exists("_r.errors", lambda e: e.startswith("severity:")) | F.coalesce(F.is_variant_null(said), F.lit(False))
    valid = ~no_number & ~F.exists("_r.errors", lambda e: e.startswith("root:"))
    found = found.withColumn("valid", valid).withColumn("_v", F.when(F.col("valid"), F.col("_r.value")).otherwise(defaults(EVENT_FORM)))
    return found.withColumns({
        "severity": F.col("_v.severity").cast("int"), "is_malicious": F.col("_v.is_malicious"), "techniques": F.slice("_v.mitre_techniques", 1, MOST_TECHNIQUES),
        "indicators": F.col("_v.indicators"), "intent": F.when(F.col("valid"), F.col("_v.intent")).otherwise("The model returned an invalid response."), "said_decoded": F.col("_v.decoded"),
        "recommendation": F.when(F.col("valid"), F.col("_v.recommendation")).otherwise("Review deterministic findings; invalid model output was discarded."),
        "source": F.when(F.col("valid"), "llm").otherwise("llm-invalid"), "errors": F.col("_r.errors"),
    }).drop("_r", "_v")


def validate_session(rows: DataFrame, column: str = "json") -> DataFrame:
    """Checked fields of reports on sessions that come as JSON (SESSION_FORM), errors, source and valid."""
    found = rows.withColumn("_r", against(SESSION_FORM, F.col(column)))
    found = found.withColumn("valid", ~F.exists("_r.errors", lambda e: e.startswith("root:")))
    return found.select("*", "_r.value.*", F.col("_r.errors").alias("errors"), F.when(F.col("valid"), "llm").otherwise("llm-invalid").alias("source")).drop("_r")


def nudge(rows: DataFrame, examples: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Scored rows moved by the nearest trusted label (key, label, corrected_severity, similarity).

    Nothing of heuristic severity 7 or more changes. A malicious label raises to 7 at least; a
    benign one lowers what is at most 6 to 2 at most. What is moved is not abstained from, and
    its indicators, if the rows have them, say why.
    """
    order = F.struct("similarity", -F.col("rank")) if "rank" in examples.columns else F.struct("similarity", "label")
    near = examples.where(F.col("similarity") >= least).groupBy(key).agg(F.max_by(F.struct("label", "corrected_severity", "similarity"), order).alias("_e"))
    joined = rows.join(near, key, "left")
    open_ = F.col("_e").isNotNull() & (F.col("severity") < 7)
    up, down = open_ & F.col("_e.label"), open_ & ~F.col("_e.label")
    seen = F.format_string("(sim=%.2f)", "_e.similarity")
    out = {
        "moved": F.coalesce(up | down, F.lit(False)),
        "severity": F.when(up, F.greatest(F.lit(7), F.coalesce("_e.corrected_severity", F.lit(7)))).when(down, F.least("severity", F.lit(2))).otherwise(F.col("severity")),
        "is_malicious": F.when(up, True).when(down, False).otherwise(F.col("is_malicious")),
        "confidence": F.when(up | down, F.round(F.greatest(F.lit(0.8), F.least("_e.similarity", F.lit(0.97))), 2)).otherwise(F.col("confidence")),
    }
    if "abstained" in rows.columns:
        out["abstained"] = F.when(up | down, False).otherwise(F.col("abstained"))
    if "source" in rows.columns:
        out["source"] = F.when(up | down, F.concat("source", F.lit("+fewshot"))).otherwise(F.col("source"))
    if "indicators" in rows.columns:
        raised = F.concat(F.lit("Analyst-labelled a near-identical command as malicious "), seen)
        cleared = F.concat(F.lit("Analyst-cleared a near-identical command as benign "), seen)
        out["indicators"] = F.when(up, F.array_union("indicators", F.array(raised))).when(down, F.concat("indicators", F.array(cleared))).otherwise(F.col("indicators"))
    return joined.withColumns(out).drop("_e")


#: What a sink keeps apart: a finding by day and severity, the rest by what they are.
SINKS = {"findings": ("day", "severity"), "incidents": ("priority",), "nodes": ("type",), "edges": ("type",)}


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as Parquet, a folder per day and severity. A day and severity written again
    replaces what it held; others stay."""
    write_parts(findings.withColumn("day", F.coalesce(F.to_date("ts").cast("string"), F.lit("none"))), path, SINKS["findings"])


def write_parts(rows: DataFrame, path: str, parts: tuple[str, ...]) -> None:
    """Rows as Parquet by folders; the folders that the rows fall into are replaced, so
    that writing the same rows twice changes nothing."""
    rows.repartition(*parts, F.pmod(F.xxhash64(*(c for c in rows.columns if c not in parts)), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_session(results: dict[str, DataFrame], path: str) -> None:
    """The findings, incidents, nodes and edges of an analysis, each in a folder of its own."""
    write_findings(results["findings"], f"{path}/findings")
    for name in ("incidents", "nodes", "edges"):
        write_parts(results[name], f"{path}/{name}", SINKS[name])


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that keeps the rows of each micro-batch in a folder of its number, so
    that a batch that is run again after a failure replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        write_parts(rows.withColumns({"batch": F.lit(number).cast("long"), "day": F.coalesce(F.to_date("ts").cast("string"), F.lit("none"))}), path, ("batch", "day", "severity"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
