"""Detection rules compiled to one scan: each rule is a literal condition."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import access_is_dangerous
from ..functions.predicates import folded, literals, matches, text


@dataclass(frozen=True)
class Rule:
    """A detection: every condition given must hold. Names and words are compared in lower case."""

    id: str
    name: str
    mitre: str = ""
    tactic: str = ""
    severity: str = "LOW"
    names: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    command: str = ""
    path: str = ""
    properties: str = ""
    target: str = ""
    dangerous: bool = False
    parents: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    outcomes: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    description: str = ""
    guidance: str = ""

    def condition(self, low: Callable[[str], Column] = text, fold: Callable[[str], Column] | None = None) -> Column | None:
        """The cheap tests first; None for a rule without conditions, which never holds.
        low: the lower-cased column of a name. fold: the folded column of a searched text;
        where it holds none of the literals that a pattern needs, the pattern is not tried."""
        tests: list[Column] = []
        for column, words in (("process_name", self.names), ("event_outcome", self.outcomes), ("action_type", self.actions), ("event_category", self.categories)):
            if words:
                tests.append(low(column).isin([w.lower() for w in words]))
        if self.codes:
            tests.append(F.coalesce(F.col("event_id"), F.lit("")).isin(list(self.codes)))
        if self.parents:
            pairs = [f"{child.lower()}\x01{p.lower()}" for child, ps in self.parents.items() for p in ps]
            tests.append(F.concat(low("process_name"), F.lit("\x01"), low("parent_process_name")).isin(pairs))
        if self.dangerous:
            tests.append(access_is_dangerous(F.col("granted_access")))
        for name, pattern in (("command", self.command), ("path", self.path), ("properties", self.properties), ("target", self.target)):
            if pattern:
                if fold is not None and (needed := literals(pattern)):
                    tests.append(reduce(or_, (F.contains(fold(name), F.lit(n)) for n in needed)))
                tests.append(matches(searched(name), pattern))
        return reduce(and_, tests) if tests else None


def searched(name: str) -> Column:
    """The text that a rule's pattern searches."""
    if name == "command":
        return F.col("commandline")
    if name == "path":
        return F.coalesce(F.nullif("process_path", F.lit("")), "process_name")
    return F.col("target_image") if name == "target" else F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("properties", "object_guid", "access_mask")))


#: Ids, names, techniques, severities, conditions and patterns of the playbook, in its order.
RULES = (
    Rule("TH-001", "Encoded PowerShell Execution", "T1059.001", "Execution", "HIGH", ("powershell.exe", "pwsh.exe"), command=r"(?i)(-[Ee]nc\b|-[Ee]ncodedCommand)"),
    Rule("TH-002", "PowerShell Download Cradle", "T1059.001", "Execution", "HIGH", ("powershell.exe", "pwsh.exe"), command=r"(?i)(Invoke-WebRequest|IWR|Invoke-RestMethod|IRM|Net\.WebClient|DownloadString|DownloadFile|Start-BitsTransfer|wget|curl)"),
    Rule("TH-003", "AMSI Bypass Attempt", "T1562.001", "Defense Evasion", "CRITICAL", ("powershell.exe", "pwsh.exe"), command=r"(?i)(AmsiUtils|amsiInitFailed|Bypass|SetValue.*AmsiEnable|Reflection\.Assembly)"),
    Rule("TH-004", "LOLBAS Proxy Execution — MSHTA", "T1218.005", "Defense Evasion", "HIGH", ("mshta.exe",), command=r"(?i)(http|javascript|vbscript|about)"),
    Rule("TH-005", "LOLBAS Proxy Execution — Rundll32", "T1218.011", "Defense Evasion", "MEDIUM", ("rundll32.exe",), command=r"(?i)(javascript|http|shell32|advpack|ieadvpack|setupapi|syssetup|url\.dll|zipfldr)"),
    Rule("TH-006", "LOLBAS Proxy Execution — Regsvr32", "T1218.010", "Defense Evasion", "HIGH", ("regsvr32.exe",), command=r"(?i)(/s|/i:http|scrobj\.dll)"),
    Rule("TH-007", "Certutil Download or Decode", "T1140", "Defense Evasion", "HIGH", ("certutil.exe",), command=r"(?i)(-urlcache|-decode|-decodehex|http)"),
    Rule("TH-008", "BITSAdmin File Transfer", "T1197", "Defense Evasion", "MEDIUM", ("bitsadmin.exe",), command=r"(?i)(/transfer|/addfile|http)"),
    Rule("TH-009", "LSASS Memory Access", "T1003.001", "Credential Access", "CRITICAL", ("procdump.exe", "procdump64.exe", "rundll32.exe", "taskmgr.exe"), command=r"(?i)(lsass|comsvcs\.dll.*MiniDump)"),
    Rule("TH-025", "LSASS Process Access (Credential Dumping)", "T1003.001", "Credential Access", "CRITICAL", codes=("10",), target=r"(?i)lsass\.exe", dangerous=True),
    Rule("TH-010", "Mimikatz Indicators", "T1003.001", "Credential Access", "CRITICAL", command=r"(?i)(sekurlsa|kerberos::list|crypto::capi|privilege::debug|token::elevate|lsadump|dcsync|logonpasswords)"),
    Rule("TH-011", "DCSync Attack", "T1003.006", "Credential Access", "CRITICAL", codes=("4662",), properties=r"(?i)(DS-Replication-Get-Changes|1131f6aa-9c07-11d1-f79f|1131f6ad-9c07-11d1-f79f|89e95b76-444d-4c62-991a)"),
    Rule("TH-012", "PsExec-style Remote Execution", "T1021.002", "Lateral Movement", "HIGH", ("psexec.exe", "psexesvc.exe")),
    Rule("TH-013", "WMI Remote Process Creation", "T1047", "Execution", "MEDIUM", ("wmic.exe", "wmiprvse.exe"), command=r"(?i)(process.*call.*create|/node:)"),
    Rule("TH-014", "Remote Service Creation via sc.exe", "T1543.003", "Persistence", "HIGH", ("sc.exe",), command=r"(?i)\\\\[^\n]{0,200}?(create|config|start)\b"),
    Rule("TH-015", "Scheduled Task Persistence", "T1053.005", "Persistence", "MEDIUM", ("schtasks.exe",), command=r"(?i)(/create|/change)"),
    Rule("TH-016", "Registry Run Key Modification", "T1547.001", "Persistence", "HIGH", ("reg.exe",), command=r"(?i)(add.*Run|add.*RunOnce)"),
    Rule("TH-017", "New Service Installation", "T1543.003", "Persistence", "MEDIUM", codes=("7045",)),
    Rule("TH-018", "Internal Network Reconnaissance", "T1018", "Discovery", "LOW", ("net.exe", "net1.exe", "nltest.exe", "dsquery.exe"), command=r"(?i)(view|user|group|domain|trust|dclist|localgroup.*admin)"),
    Rule("TH-019", "System Information Discovery", "T1082", "Discovery", "LOW", ("systeminfo.exe", "hostname.exe", "whoami.exe", "ipconfig.exe")),
    Rule("TH-020", "DNS over HTTPS or Uncommon DNS", "T1071.004", "Command and Control", "MEDIUM", command=r"(?i)(dns\.google|cloudflare-dns\.com|doh\.opendns\.com|1\.1\.1\.1\/dns-query)"),
    Rule("TH-021", "Named Pipe Impersonation", "T1134.001", "Privilege Escalation", "HIGH", codes=("17", "18"), command=r"(?i)(pipe|impersonate)"),
    Rule("TH-022", "Unusual Parent-Child Relationship", "T1055", "Defense Evasion", "HIGH", parents={
        "cmd.exe": ("services.exe", "lsass.exe", "smss.exe"),
        "powershell.exe": ("services.exe", "lsass.exe", "smss.exe", "wmiprvse.exe"),
        "whoami.exe": ("services.exe", "lsass.exe"),
        "net.exe": ("lsass.exe", "smss.exe"),
    }),
    Rule("TH-023", "Unsigned Binary Execution from Temp", "T1204.002", "Execution", "HIGH", path=r"(?i)(\\temp\\|\\tmp\\|\\appdata\\local\\temp|\\downloads\\)"),
    Rule("TH-024", "Process Hollowing / Injection Indicators", "T1055.012", "Defense Evasion", "CRITICAL", codes=("8", "10"), command=r"(?i)(NtUnmapViewOfSection|WriteProcessMemory|VirtualAllocEx|CreateRemoteThread)"),
)
RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
_OF_RULE = ("rule_id", "rule_name", "mitre", "tactic", "severity")
_OF_EVENT = (
    "seq", "ts", "hostname", "user_name", "process_guid", "process_name", "commandline", "source_ip", "event_id", "event_outcome", "action_type", "target_image",
    "granted_access",
)
FINDING = ["rule_ord", *_OF_RULE, *_OF_EVENT]


def _words(value) -> tuple[str, ...]:
    return tuple(map(str, value)) if isinstance(value, list) else (str(value),) if value else ()


def load_playbook(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules of a playbook file in YAML or JSON, read through Spark; an unusable pattern is an error."""
    whole = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        book = json.loads(whole)
    else:
        import yaml

        book = yaml.safe_load(whole)
    rules = []
    for r in book.get("rules", []):
        m = r.get("match") or {}
        rule = Rule(
            str(r["id"]), str(r["name"]), r.get("mitre", ""), r.get("tactic", ""), r.get("severity", "LOW"), names=_words(m.get("process_name")),
            codes=_words(m.get("event_id")), command=m.get("commandline_regex", ""), path=m.get("process_path_regex", ""),
            properties=m.get("properties_regex") or m.get("object_guid_regex") or "", target=m.get("target_image_regex", ""), dangerous=bool(m.get("granted_access_dangerous")),
            parents={k: tuple(v) for k, v in m.get("suspicious_parents", {}).items()} if m.get("parent_child_anomaly") else {}, outcomes=_words(m.get("event_outcome")),
            actions=_words(m.get("action_type")), categories=_words(m.get("event_category")), description=r.get("description", ""), guidance=r.get("hunt_guidance", ""),
        )
        for pattern in (rule.command, rule.path, rule.properties, rule.target):
            try:
                re.compile(pattern)
            except re.error as wrong:
                raise ValueError(f"rule {rule.id}: {wrong}") from wrong
        rules.append(rule)
    return tuple(rules)


def summary(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a dimension of findings."""
    rows = [(i, r.id, r.name, r.mitre, r.tactic, r.severity, r.description, r.guidance) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, rule_name string, mitre string, tactic string, severity string, description string, hunt_guidance string")


def evaluate(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per event and rule that matches; one scan, no join. Names are lower-cased and
    searched texts folded once; a pattern is tried only where a literal that it needs occurs."""
    hits, names = [], ("process_name", "parent_process_name", "event_outcome", "action_type", "event_category")
    events = events.withColumns({f"_low_{c}": text(c) for c in names} | {f"_fold_{c}": folded(searched(c)) for c in ("command", "path", "properties", "target")})
    for i, r in enumerate(rules):
        if (condition := r.condition(lambda c: F.col(f"_low_{c}"), lambda c: F.col(f"_fold_{c}"))) is not None:
            values = zip(_OF_RULE, (r.id, r.name, r.mitre, r.tactic, r.severity))
            hits.append(F.when(condition, F.struct(F.lit(i).alias("rule_ord"), *(F.lit(v).alias(n) for n, v in values))))
    found = events.withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return found.select("_hit.*", *_OF_EVENT)


def dedup(findings: DataFrame) -> DataFrame:
    """The first finding by (seq, rule) per rule, process or command, source, user and host; a hash aggregate."""
    actor = F.coalesce(F.nullif("process_guid", F.lit("")), F.col("commandline"), F.lit(""))
    keys = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in ("source_ip", "user_name", "hostname")]
    first = findings.groupBy("rule_id", actor.alias("_actor"), *keys).agg(F.min_by(F.struct(*FINDING), F.struct("seq", "rule_ord")).alias("f"))
    return first.select("f.*")


def severity_counts(findings: DataFrame) -> DataFrame:
    """All four severities, with their share of all findings."""
    sums = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in RANK), F.count("*").alias("total"))
    pairs = F.inline(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings"), F.round(100.0 * F.col(s) / F.greatest("total", F.lit(1)), 4).alias("share")) for s in RANK)))
    return sums.select(pairs)


#: Names that stand for users who do not exist.
INVALID_USERS = ["(invalid user)", "(unknown user)", "(unknown)", "invalid user", "unknown user", "unknown"]


def is_invalid_user(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(INVALID_USERS)


def logons(events: DataFrame) -> DataFrame:
    return events.where((text("process_name") == "sshd") | (text("event_category") == "authentication")).where("source_ip <> ''")


def tries(auth: DataFrame, *keys: Column | str) -> DataFrame:
    """Per key the failures of users who do not exist, those of others and the successes, with
    their names and times. One aggregate: partial sums leave at most one row per key and task
    before the shuffle."""
    failed, won, invalid = text("event_outcome") == "failed", text("event_outcome") == "success", is_invalid_user(F.col("user_name"))

    def named(test: Column, column: str, out: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(test & (F.col(column) != ""), F.col(column)))), ", ").alias(out)

    return auth.groupBy(*keys).agg(
        F.count_if(failed & invalid).alias("invalid"), F.count_if(failed & ~invalid).alias("real"), F.count_if(won).alias("won"),
        named(won, "user_name", "won_users"), named(failed & ~invalid, "user_name", "real_users"), named(failed | won, "hostname", "hosts"),
        F.min(F.when(failed & invalid, F.col("ts"))).alias("first_seen"),
        F.max(F.when(won, F.col("ts"))).alias("last_won"), F.max(F.when(failed & ~invalid, F.col("ts"))).alias("last_real"), F.max(F.when(failed & invalid, F.col("ts"))).alias("last_invalid"),
    )


def cases(per: DataFrame, least: int, *keys: str) -> DataFrame:
    """What the tries of a key amount to, where users who do not exist failed `least` times."""

    def case(rule, name, severity, users, last):
        return F.struct(F.lit(rule).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), users.alias("accounts"), F.col(last).alias("last_seen"))

    of_key = F.array(
        F.when(F.col("won") > 0, case("TH-CORR-001", "SSH Brute Force — Account Compromised", "CRITICAL", F.col("won_users"), "last_won")),
        F.when(F.col("real") > 0, case("TH-CORR-002", "SSH Brute Force — Valid Account Targeted", "HIGH", F.col("real_users"), "last_real")),
        F.when((F.col("won") == 0) & (F.col("real") == 0), case("TH-CORR-003", "SSH User Enumeration Detected", "MEDIUM", F.lit(""), "last_invalid")),
    )
    found = per.where(F.col("invalid") >= least).select(*keys, "invalid", "hosts", "first_seen", F.explode(F.filter(of_key, lambda c: c.isNotNull())).alias("c"))
    return found.select(
        "c.rule_id", "c.rule_name", F.lit("T1110.001").alias("mitre"), F.lit("Credential Access").alias("tactic"), "c.severity", *keys, F.col("invalid").alias("invalid_failures"),
        "hosts", "c.accounts", "first_seen", "c.last_seen",
    )


def bruteforce(events: DataFrame, least: int = 5) -> DataFrame:
    """Per source with at least `least` failures of users who do not exist, what else it did."""
    return cases(tries(logons(events), "source_ip"), least, "source_ip")
