"""Command heuristics: indicators in the activity of events, and what follows from them.

Patterns run once per distinct text; their results are joined back to the events.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.decode import decode_commands
from ..functions.predicates import OPS, matches, steering
from .severity import TACTICS, confidence_of_number, number_of_word, tactic_of, word_of_number
from .shared import Scratch
from .verdicts import REPLICATION_RIGHTS, replication_right, replication_signs, used_right

#: Pattern, indicator, severity, technique; in their order.
CHECKS = (
    (r"(?i)\[Runtime\.InteropServices\.Marshal\]::", "Marshal direct memory access (AMSI/ETW patch)", 10, "T1562.001"),
    (r"(?i)WriteInt32|WriteInt64|WriteByte", "Marshal memory write primitive", 9, "T1562.001"),
    (r"0x41414141|0x42424242|0xcafebabe|0xDEADBEEF", "AMSI/ETW memory patch magic bytes", 10, "T1562.001"),
    (r"(?i)amsiContext|amsiInitialize|amsiScanBuffer|amsiOpenSession", "AMSI internal function/field name", 10, "T1562.001"),
    (r"(?i)AmsiUtils|amsiInitFailed", "AMSI utility class direct reference", 9, "T1562.001"),
    (r"(?i)\[Ref\]\.Assembly\.GetType", "Reflection GetType (often used with format obfuscation)", 8, "T1059.001"),
    (r"(?i)GetField.*NonPublic|NonPublic.*GetField", "Reflection non-public field access", 9, "T1562.001"),
    (r"(?i)\[Reflection\.BindingFlags\]", "Reflection BindingFlags manipulation", 7, "T1059.001"),
    (r'"\{[0-9]+\}[^"]*\{[0-9]+\}[^"]*"\s*-f', "PowerShell format-string obfuscation (type name hiding)", 8, "T1027"),
    (r"(?i)\('[a-z]{1,6}'\+'[a-z]{1,6}'\+", "PowerShell string-concat obfuscation", 7, "T1027"),
    (r"(?i)\('[A-Za-z]{1,8}'\+", "PowerShell string-concat obfuscation", 6, "T1027"),
    (r"(?i)EtwEventWrite|EtwpCreateEtwThread|NtTraceEvent", "ETW bypass function", 10, "T1562.006"),
    (r"(?i)EventWrite.*patch|patch.*EventWrite", "ETW event write patching", 9, "T1562.006"),
    (r"(?i)-[Ee]nc(odedCommand)?\b", "Base64-encoded PowerShell command", 7, "T1059.001"),
    (r"(?i)(Invoke-WebRequest|DownloadString|DownloadFile|IWR|Net\.WebClient)", "Download cradle", 6, "T1059.001"),
    (r"(?i)-[Ww]\s*[Hh]idden", "Hidden window PowerShell", 5, "T1059.001"),
    (r"(?i)-[Ee][Pp]\s*(bypass|unrestricted)", "ExecutionPolicy bypass", 5, "T1059.001"),
    (r"(?i)Invoke-Expression|IEX\s*\(|IEX\s*`", "Invoke-Expression execution", 6, "T1059.001"),
    (r"(?i)(sekurlsa|kerberos::list|lsadump|dcsync|logonpasswords)", "Mimikatz / credential module", 10, "T1003.001"),
    (r"(?i)(lsass|comsvcs.*MiniDump|procdump.*lsass)", "LSASS memory dump", 10, "T1003.001"),
    (r"(?i)DS-Replication-Get-Changes", "DCSync replication right", 10, "T1003.006"),
    (r"(?i)(certutil.*-urlcache|certutil.*-decode)", "Certutil abuse", 7, "T1140"),
    (r"(?i)(mshta.*http|mshta.*javascript)", "MSHTA proxy execution", 8, "T1218.005"),
    (r"(?i)(rundll32.*javascript|rundll32.*shell32)", "Rundll32 abuse", 7, "T1218.011"),
    (r"(?i)(wmic.*process.*call.*create|wmic.*/node:)", "WMI remote execution", 6, "T1047"),
    (r"(?i)(bitsadmin.*/transfer)", "BITS file transfer", 5, "T1197"),
    (r"(?i)regsvr32.*(/s|/i:|scrobj)", "Regsvr32 proxy execution", 7, "T1218.010"),
    (r"(?i)schtasks.*/create", "Scheduled task creation", 5, "T1053.005"),
    (r"(?i)reg.*add.*(Run|RunOnce)", "Registry Run key persistence", 7, "T1547.001"),
    (r"(?i)(psexec|PsExeSvc)", "PsExec remote execution", 6, "T1021.002"),
    (r"(?i)Invoke-Command.*-ComputerName", "PowerShell WinRM remoting", 6, "T1021.006"),
    (r"(?i)(sc|net).*\\\\[A-Za-z].*create", "Remote service creation", 7, "T1543.003"),
)
#: A note for security event ids.
EVENT_NOTES = {
    "4662": "Windows Security: AD object access — critical for DCSync detection.",
    "4768": "Kerberos TGT request — watch for AS-REP roasting.",
    "4769": "Kerberos service ticket — watch for Kerberoasting.",
    "4776": "NTLM authentication — watch for pass-the-hash.",
    "4771": "Kerberos pre-auth failed — watch for password spraying.",
    "7045": "New service installed — common persistence technique.",
}
#: Technique -> (field, operator, value) tests, any of which is evidence.
EVIDENCE = {
    "T1003.001": [("commandline", "regex", r"(?i)(lsass|sekurlsa|mimikatz|procdump|comsvcs)"), ("target_image", "contains", "lsass")],
    "T1003.006": [("commandline", "regex", r"(?i)(dcsync|replication|drsuapi)"), ("properties", "regex", r"(?i)(replication|1131f6a)")],
    "T1059.001": [("process_name", "eq", "powershell.exe")],
    "T1027": [("commandline", "regex", r"(?i)(-e(nc)?\b|frombase64)")],
    "T1562.001": [("commandline", "regex", r"(?i)amsi")],
    "T1562.006": [("commandline", "regex", r"(?i)(etweventwrite|nttraceevent)")],
    "T1218.005": [("process_name", "eq", "mshta.exe")],
    "T1218.010": [("process_name", "eq", "regsvr32.exe")],
    "T1218.011": [("process_name", "eq", "rundll32.exe")],
    "T1053.005": [("commandline", "contains", "schtasks")],
    "T1547.001": [("commandline", "regex", r"(?i)reg.*add.*(run|runonce)")],
    "T1021.002": [("commandline", "regex", r"(?i)psexec")],
    "T1021.006": [("commandline", "regex", r"(?i)invoke-command")],
    "T1110.001": [("process_name", "eq", "sshd")],
    "T1047": [("commandline", "regex", r"(?i)wmic")],
    "T1140": [("commandline", "regex", r"(?i)certutil")],
}
#: The fields of an event's activity, in order.
ACTIVITY = ("commandline", "message", "process_name", "process_path", "target_object", "properties")
HIT = "struct<indicator: string, severity: int, technique: string>"


def activity(events: DataFrame) -> Column:
    return F.concat_ws(" | ", *(F.nullif(F.col(c), F.lit("")) for c in ACTIVITY if c in events.columns))


def hits(text: Column, is_4662: Column) -> Column:
    """The indicators of a text, in the order of the checks; replication rights of a 4662 first."""

    def hit(indicator: str, severity: int, technique: str) -> Column:
        return F.struct(F.lit(indicator).alias("indicator"), F.lit(severity).alias("severity"), F.lit(technique).alias("technique"))

    rights = [F.when(is_4662 & F.contains(F.lower(text), F.lit(g)), hit(f"DCSync GUID: {n}", 10, "T1003.006")) for g, n in REPLICATION_RIGHTS.items()]
    checks = [F.when(matches(text, p), hit(i, s, t)) for p, i, s, t in CHECKS]
    return F.filter(F.array(*rights, *checks), lambda h: h.isNotNull()).cast(f"array<{HIT}>")


def _scored(rows: DataFrame) -> DataFrame:
    """severity (1 at least), techniques and indicators from the column hits."""
    return rows.withColumns({
        "severity": F.coalesce(F.array_max(F.transform("hits", lambda h: h["severity"])), F.lit(1)),
        "techniques": F.array_distinct(F.transform("hits", lambda h: h["technique"])), "indicators": F.transform("hits", lambda h: h["indicator"]),
    }).drop("hits")


def event_semantics(events: DataFrame) -> DataFrame:
    """Events with severity, techniques and indicators of their activity.

    The judged texts are written first, so that the join with the events is one that may be
    split where a text (an empty one, say) is very frequent.
    """
    is_4662 = F.coalesce(F.col("event_id") == "4662", F.lit(False))
    keyed = events.withColumns({"activity": activity(events), "is_4662": is_4662})
    texts = keyed.select("activity", "is_4662").distinct()
    judged = _scored(texts.withColumn("hits", hits(F.col("activity"), F.col("is_4662"))))
    return keyed.join(Scratch(events.sparkSession, "semantics").keep(judged, "texts"), ["activity", "is_4662"]).drop("is_4662")


def with_replication(scored: DataFrame) -> DataFrame:
    """Scored events, those that use a replication right judged by that alone: severity 10."""
    right = used_right(F.col("activity"), scored)
    used = right.isNotNull()
    return scored.withColumns({
        "severity": F.when(used, F.lit(10)).otherwise(F.col("severity")),
        "techniques": F.when(used, F.array(F.lit("T1003.006"))).otherwise(F.col("techniques")),
        "indicators": F.when(used, replication_signs(right, F.col("user_name"))).otherwise(F.col("indicators")),
    })


def escalate(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """Severity and indicators raised by the rules that match the same event."""
    number = number_of_word(F.col("severity"))
    strong = F.when(number >= 8, F.struct("rule_ord", F.concat(F.lit("Rule match: "), "rule_name").alias("name")))
    rules = findings.groupBy("seq").agg(F.max(number).alias("_n"), F.array_sort(F.collect_list(strong)).alias("_names"))
    names = F.coalesce(F.transform("_names", lambda x: x["name"]), F.array().cast("array<string>"))
    joined = scored.join(rules, "seq", "left")
    return joined.withColumns({"severity": F.greatest("severity", F.coalesce("_n", F.lit(1))), "indicators": F.array_union("indicators", names)}).drop("_n", "_names")


def event_notes(events: DataFrame) -> DataFrame:
    """Adds the note of an event id, null if there is none; six literals, no join."""
    note = F.element_at(F.create_map(*(F.lit(x) for pair in EVENT_NOTES.items() for x in pair)), F.coalesce("event_id", F.lit("")))
    return events.withColumn("note", note)


#: The least severity of a hit.
LEAST_HIT = 5


def semantic_hits(scored: DataFrame, most: int | None = 100) -> DataFrame:
    """Events of severity 5 or more, the most severe and then the first ones."""
    found = scored.where(f"severity >= {LEAST_HIT}").orderBy(F.desc("severity"), "seq")
    return found.limit(most) if most else found


#: What to do next if nothing was found, if something was, and for a phase.
NOTHING = "Continue rule evaluation and review timeline/process graph for environment-specific anomalies."
SOMETHING = "Prioritize initial findings with severity 7 or higher before broad triage."
PHASE_STEPS = {
    "Credential Access": "Validate affected identities, rotate credentials where compromise is plausible, and hunt for reuse.",
    "Defense Evasion": "Collect process memory, script block logs, and EDR telemetry for evasion artifacts.",
    "Lateral Movement": "Correlate source/destination hosts and remote execution events in chronological order.",
}
#: Rows of a report's lists: findings, timeline.
SHOWN_FINDINGS, SHOWN_TIMES = 100, 200
ITEM = "struct<item: string, ord: int, value: string, n: bigint>"


def prescan(events: DataFrame, most: int | None = None, findings: int = SHOWN_FINDINGS, times: int = SHOWN_TIMES, scored: DataFrame | None = None) -> DataFrame:
    """The first report on a table of events as rows (item, ord, value, n).

    Items: overall_severity (n: hits), phase (n: hits), next_step in order, finding (the most
    severe hits: seq and indicators, n: severity), top counts, process edge, and timeline (the
    first events by time). Severity, phases and steps come from all hits, or the first `most`.
    scored: the events as with_replication judges them, if that is at hand.
    """
    from .summaries import process_edges, top_counts

    judged = (with_replication(event_semantics(events)) if scored is None else scored).select("seq", "severity", "techniques", "indicators")
    hit = judged.where(f"severity >= {LEAST_HIT}") if most is None else semantic_hits(judged, most)
    found = Scratch(events.sparkSession, "prescan").keep(hit, "hits")
    phases = sorted(set(TACTICS.values()))
    tactics = F.transform("techniques", tactic_of)
    counts = [F.count_if(F.array_contains(tactics, p)).alias(f"p{i}") for i, p in enumerate(phases)]
    whole = found.agg(F.count("*").alias("n"), F.coalesce(F.max("severity"), F.lit(1)).alias("worst"), *counts)

    def item(name: str, value: Column, n: Column, ord_: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("item"), (F.lit(1) if ord_ is None else ord_).alias("ord"), value.alias("value"), n.cast("long").alias("n"))

    number = {p: F.col(f"p{i}") for i, p in enumerate(phases)}
    seen = [F.when(n > 0, item("phase", F.lit(p), n)) for p, n in number.items()]
    steps = [F.when(F.col("n") > 0, F.lit(SOMETHING)).otherwise(F.lit(NOTHING)), *(F.when(number[p] > 0, F.lit(step)) for p, step in PHASE_STEPS.items())]
    steps = F.transform(F.array_compact(F.array(*steps)), lambda s, i: item("next_step", s, F.lit(1), i + 1).cast(ITEM))
    known = F.array_compact(F.array(item("overall_severity", word_of_number(F.col("worst")), F.col("n")).cast(ITEM), *(s.cast(ITEM) for s in seen)))
    out = whole.select(F.inline(F.concat(known, steps)))

    def placed(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
        return rows.orderBy(*order).limit(most).withColumn("ord", F.row_number().over(W.orderBy(*order)))

    best = placed(found, [F.desc("severity"), F.asc("seq")], findings)
    out = out.union(best.select(F.lit("finding"), "ord", F.concat_ws(" ", "seq", F.array_join("indicators", "; ")), F.col("severity").cast("long")))
    top = top_counts(events)
    out = out.union(top.select(F.concat(F.lit("top "), "field"), "rank", "value", "n"))
    edges = process_edges(events.where("parent_process_name <> '' and process_name <> ''"))
    out = out.union(edges.select(F.lit("process edge"), F.lit(1), F.concat("parent", F.lit(" > "), "child"), "n"))
    first = placed(events.where("ts is not null").select("seq", "ts", "process_name", "hostname", "event_id"), [F.asc("ts"), F.asc("seq")], times)
    return out.union(first.select(F.lit("timeline"), "ord", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "process_name", "hostname", "event_id"), F.lit(1)))


#: What a verdict on a command depends on, beside the command.
CONTEXT = ("event_id", "process_name", "hostname", "user_name", "properties", "object_guid")


def score_commands(events: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """A verdict per distinct command and context (CONTEXT; columns that the events lack are null).

    A used replication right decides alone (source dcsync); else what the text and the text
    hidden in it show, raised by the rules that match an event of that context, if their
    findings are given. heuristic is the severity without the replication right; confidence falls
    where both disagree. degraded: the command or its context tries to steer a model, so that
    none should be asked about it. Texts are judged once each and written, then joined to the contexts.
    Events without a command have no verdict; verdicts.nudge adds the feedback of analysts.
    """
    lacking = {c: F.lit(None).cast("string") for c in CONTEXT if c not in events.columns}
    rows = events.where("commandline is not null").withColumns(lacking) if lacking else events.where("commandline is not null")
    keys = ["commandline", *CONTEXT]
    if findings is None:
        contexts = rows.select(*keys).distinct().withColumns({"_n": F.lit(1), "_names": F.array().cast("array<string>")})
    else:
        number = number_of_word(F.col("severity"))
        strong = F.when(number >= 8, F.struct("rule_ord", F.concat(F.lit("Rule match: "), "rule_name").alias("name")))
        marked = rows.select("seq", *keys).join(findings.select("seq", number.alias("_n"), strong.alias("_r")), "seq", "left")
        contexts = marked.groupBy(*keys).agg(F.coalesce(F.max("_n"), F.lit(1)).alias("_n"), F.array_sort(F.collect_set("_r")).alias("_names"))
        contexts = contexts.withColumn("_names", F.transform("_names", lambda x: x["name"]))
    text = F.concat_ws("\n# decoded:\n", "commandline", "decoded")
    judged = decode_commands(rows).withColumns({"_right": replication_right(text), "hits": hits(text, F.lit(False))})
    texts = Scratch(events.sparkSession, "commands").keep(_scored(judged).drop("candidates"), "texts")
    out = contexts.join(texts, "commandline")
    is_4662 = F.coalesce(F.col("event_id") == "4662", F.lit(False))
    named = F.when(is_4662 & F.col("_right").isNotNull(), 10).otherwise(F.col("severity"))
    out = out.withColumns({"matched_right": F.coalesce("_right", used_right(F.lit(None).cast("string"), out)), "heuristic": F.greatest(named, "_n")})
    used = F.col("matched_right").isNotNull()
    out = out.withColumns({
        "severity": F.when(used, F.lit(10)).otherwise(F.col("heuristic")),
        "techniques": F.when(used, F.array(F.lit("T1003.006"))).otherwise(F.col("techniques")),
        "indicators": F.when(used, replication_signs(F.col("matched_right"), F.col("user_name"))).otherwise(F.array_union("indicators", "_names")),
        "source": F.when(used, "dcsync").otherwise("heuristic"),
    })
    out = steering(out, "commandline", *CONTEXT).withColumns({"is_malicious": F.col("severity") >= 5, "degraded": ~used & F.col("steers")}).drop("steers")
    return confidence(out, F.col("heuristic"), F.col("is_malicious") == (F.col("heuristic") >= 5)).drop("_right", "_n", "_names")


def confidence(rows: DataFrame, heuristic: Column, agree: Column) -> DataFrame:
    """Adds confidence and abstained from severity, the heuristic one, indicators, and whether both agree."""
    n = F.size("indicators")
    strong, benign = (F.col("severity") >= 7) | (heuristic >= 7), (F.col("severity") <= 2) & (n == 0)
    value = F.when(strong, F.least(F.lit(0.95), 0.7 + 0.05 * n)).when(benign, 0.7).otherwise(0.4)
    return rows.withColumns({"confidence": F.round(F.when(agree, value).otherwise(F.least(value, F.lit(0.45))), 2), "abstained": ~agree | ~(strong | benign)})


def validation_hunt(technique: str) -> dict:
    """The hunt for evidence of a technique: any of its tests, or any process if it has none."""
    tests = EVIDENCE.get(technique, [("process_name", "ne", "")])
    step = {"id": "a", "match": "any", "predicates": [{"field": f, "op": o, "value": v} for f, o, v in tests]}
    return {"description": f"Validate {technique} activity", "steps": [step], "relations": [], "select": "a"}


def hypotheses(scored: DataFrame, findings: DataFrame, most: int | None = 12) -> DataFrame:
    """Techniques that activity suggests and no rule has confirmed on that host, the most severe
    first: the most severe event of each, what is suspected and why, and the hunt (JSON, for
    hunt.checked and run_hunt) that would validate it."""
    confirmed = findings.where("mitre <> ''").select(F.col("mitre").alias("technique"), F.coalesce("hostname", F.lit("")).alias("host")).distinct()
    signs = F.array_join(F.slice("indicators", 1, 3), ", ").alias("signs")
    shown = scored.where("severity >= 5").select("seq", "severity", F.coalesce("hostname", F.lit("")).alias("host"), "user_name", signs, F.explode("techniques").alias("technique"))
    new = drop_confirmed(shown, confirmed)
    best = new.groupBy("technique").agg(F.max_by(F.struct("severity", "host", "user_name", "seq", "signs"), F.struct("severity", -F.col("seq"))).alias("b"))
    order = (F.desc("severity"), F.asc("seq"), F.asc("technique"))
    top = best.select("technique", "b.*").orderBy(*order)
    top = top.limit(most) if most else top
    by = F.when(F.col("user_name") != "", F.concat(F.lit(" by "), "user_name")).otherwise("")
    known = {t: json.dumps(validation_hunt(t)) for t in EVIDENCE}
    asked = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col("technique"))
    other = F.replace(F.lit(json.dumps(validation_hunt("$"))), F.lit("$"), F.col("technique"))
    # one row per technique, so that a single task may number them
    return top.withColumns({
        "id": F.concat(F.lit("hyp_"), F.row_number().over(W.orderBy(*order)) - 1), "confidence": confidence_of_number(F.col("severity")),
        "hypothesis": F.concat(F.lit("Suspected "), "technique", F.lit(" activity on "), F.coalesce(F.nullif("host", F.lit("")), F.lit("a host")), by, F.lit(" — not yet matched by a detection rule.")),
        "rationale": F.concat(F.lit("Suspected (no rule match): "), F.coalesce(F.nullif("signs", F.lit("")), F.lit("suspicious activity")), F.lit(" (severity "), "severity", F.lit(").")),
        "validation_query": F.coalesce(asked, other),
    }).drop("signs")


def with_evidence(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows with a technique and how many events its validation hunt finds; one scan for all."""
    counts = evidence(events).agg(F.map_from_entries(F.collect_list(F.struct("technique", "evidence"))).alias("_known"))
    others = events.agg(F.count_if(F.coalesce(F.col("process_name") != "", F.lit(False))).alias("_others"))
    one = counts.crossJoin(others)
    return rows.crossJoin(F.broadcast(one)).withColumn("evidence", F.coalesce(F.element_at("_known", F.col("technique")), "_others")).drop("_known", "_others")


def drop_confirmed(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Rows (technique, host, ...) that no rule has confirmed: for that host, or anywhere if it is empty."""
    anywhere = confirmed.select("technique").distinct()
    known = rows.where("host <> ''").join(confirmed, ["technique", "host"], "left_anti")
    return known.unionByName(rows.where("host = ''").join(anywhere, "technique", "left_anti"))


def evidence(events: DataFrame) -> DataFrame:
    """Per technique how many events are evidence; all techniques in one scan."""
    counts = events.agg(*(F.count_if(_any([OPS[o](f, v) for f, o, v in tests])).alias(t.replace(".", "_")) for t, tests in EVIDENCE.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(t).alias("technique"), F.col(t.replace(".", "_")).alias("evidence")) for t in EVIDENCE))))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def grounded(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Hypotheses (id, hosts, users: arrays) that name no host or user absent from the events."""
    for names, column in (("hosts", "hostname"), ("users", "user_name")):
        known = events.select(F.lower(column).alias("name")).where("name is not null").distinct()
        wrong = rows.select("id", F.explode(names).alias("name")).select("id", F.lower("name").alias("name")).join(known, "name", "left_anti").select("id").distinct()
        rows = rows.join(wrong, "id", "left_anti")
    return rows
