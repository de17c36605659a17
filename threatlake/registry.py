"""The registered queries over security events, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decode, predicates
from .functions.normalize import DNS_NAMESPACE, access_is_dangerous, basename, canonical, outcome, parent_guid, process_guid, timestamp
from .operators import graph, heuristics, hunt, incidents, rules, session, severity, summaries, vectors, verdicts
from .sources import readers
from .sources.tables import EVENTS_SQL, FEEDBACK_SQL, TRUSTED, events, feedback

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}



def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _search(column: str, pattern: str) -> str:
    return f"coalesce({column} <> '' and regexp_matches({column}, {_lit(pattern)}), false)"


def _one_of(column: str, words: tuple[str, ...]) -> str:
    return f"coalesce(lower({column}), '') in ({', '.join(_lit(w.lower()) for w in words)})"


def _rule_sql(r: rules.Rule) -> str:
    """The condition of a rule for DuckDB, put together from the rule's fields."""
    tests = [_one_of("process_name", r.names)] * bool(r.names) + [_one_of("event_id", r.codes)] * bool(r.codes)
    tests += [_search("commandline", r.command)] * bool(r.command) + [_search("case when process_path <> '' then process_path else process_name end", r.path)] * bool(r.path)
    tests += [_search("(coalesce(properties, '') || ' ' || coalesce(object_guid, '') || ' ' || coalesce(access_mask, ''))", r.properties)] * bool(r.properties)
    tests += [_search("target_image", r.target)] * bool(r.target) + ["granted_access in ('0x1410', '0x40')"] * r.dangerous
    if r.parents:
        tests.append("(" + " or ".join(f"{_one_of('process_name', (c,))} and {_one_of('parent_process_name', ps)}" for c, ps in r.parents.items()) + ")")
    return " and ".join(tests)


_FCOLS = ", ".join(rules.FINDING)
_FINDINGS = ", fi as (" + " union all ".join(
    f"select {i} as rule_ord, '{r.id}' as rule_id, {_lit(r.name)} as rule_name, '{r.mitre}' as mitre, '{r.tactic}' as tactic, '{r.severity}' as severity, * from ev where {_rule_sql(r)}"
    for i, r in enumerate(rules.RULES)
) + ")"
_DEDUP = """, de as (select * from (select *, row_number() over (partition by rule_id, coalesce(nullif(process_guid, ''), commandline, ''), source_ip, user_name, hostname order by seq, rule_ord) as rn from fi) x where rn = 1)"""
_RANK = "case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"


def query(sql: str | None = None, with_: str = ""):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = f"with recursive {EVENTS_SQL}{with_} {sql}"
        return f

    return keep


def _step(op: str, field: str, value) -> dict:
    return {"match": "all", "predicates": [{"field": field, "op": op, "value": value}]}


def _pred(name: str, spec: dict, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return events(spark, sf_dir).where(predicates.step(spec)).select("seq", "hostname", "user_name")

    run.__name__ = name
    query(f"select seq, hostname, user_name from ev where {where}")(run)


_pred("pred_eq_ne", {"match": "all", "predicates": [{"field": "process_name", "op": "eq", "value": "SSHD"}, {"field": "event_outcome", "op": "ne", "value": "failed"}]}, "process_name = 'sshd' and coalesce(event_outcome, '') <> 'failed'")
_pred("pred_contains", _step("contains", "commandline", "LSASS"), "contains(lower(commandline), 'lsass')")
_pred("pred_regex", _step("regex", "commandline", r"-enc\b|minidump"), "regexp_matches(commandline, '(?i)(-enc\\b|minidump)')")
_pred("pred_in", _step("in", "source_ip", ["10.0.0.3", "10.0.0.17"]), "source_ip in ('10.0.0.3', '10.0.0.17')")
_pred("pred_gte_lte", {"match": "all", "predicates": [{"field": "event_id", "op": "gte", "value": 10}, {"field": "event_id", "op": "lte", "value": 4662}]}, "try_cast(event_id as double) between 10 and 4662")
_pred("pred_match_all_any", {"match": "any", "predicates": [{"field": "hostname", "op": "eq", "value": "host-3"}, {"field": "event_outcome", "op": "eq", "value": "success"}]}, "hostname = 'host-3' or event_outcome = 'success'")


@query("select * from ev")
def src_tables(spark, sf_dir):
    return events(spark, sf_dir)


@query("select nullif(conv_id, 0) as conv_id, nullif(turn, 0) as turn, nullif(role, '') as role, nullif(text, '') as text from conversations")
def src_json(spark, sf_dir):
    """Conversations written as JSON arrays, one a file, and read back by byte ranges; a zero or an
    empty text counts as missing."""
    from .operators.shared import Scratch

    path = f"{Scratch(spark, 'arrays').base}/json"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    readers.write_arrays(rows, path)
    raw = readers.read_json(spark, path)
    return raw.select(*(F.element_at("raw", c).cast(t).alias(c) for c, t in rows.dtypes))


@query("select seq, granted_access in ('0x1410', '0x40') as dangerous from ev")
def mask_dangerous(spark, sf_dir):
    return events(spark, sf_dir).select("seq", access_is_dangerous(F.col("granted_access")).alias("dangerous"))


@query("select seq, regexp_extract(process_path, '([^\\\\/]*)$', 1) as name from ev")
def norm_basename(spark, sf_dir):
    return events(spark, sf_dir).select("seq", basename(F.col("process_path")).alias("name"))


@query("select seq, case when event_outcome is null then '' else event_outcome end as outcome from ev")
def norm_outcome(spark, sf_dir):
    noisy = F.concat(F.upper("event_outcome"), F.lit("'tail"))
    return events(spark, sf_dir).select("seq", F.coalesce(outcome(noisy), F.lit("")).alias("outcome"))


_ACTIVITY = "concat_ws(' | ', " + ", ".join(f"nullif({c}, '')" for c in heuristics.ACTIVITY) + ")"


@query(f"select seq, {_ACTIVITY} as activity from ev")
def activity_text(spark, sf_dir):
    return events(spark, sf_dir).select("seq", heuristics.activity(events(spark, sf_dir)).alias("activity"))


@query(" union all ".join(f"select '{t}' as source, count(*) as scanned, count(*) filter (coalesce(regexp_matches(text, {_lit(predicates.MARKERS)}), false)) as flagged from {t}" for t in ("conversations", "documents", "benchmark")))
def prompt_injection_scan(spark, sf_dir):
    """Texts with such words in every table of texts, whole texts; as plain, listed and mapped values."""
    shapes = {"conversations": F.col("text"), "documents": F.array(F.struct("source", "text")), "benchmark": F.create_map(F.lit("item"), F.array("text"))}
    counts = []
    for t, value in shapes.items():
        rows = predicates.steering(spark.read.parquet(f"{sf_dir}/{t}.parquet").select(value.alias("value")), "value")
        counts.append(rows.agg(F.lit(t).alias("source"), F.count("*").alias("scanned"), F.count_if("steers").alias("flagged")))
    return reduce(DataFrame.union, counts)


@query(f"select {_FCOLS} from fi", _FINDINGS)
def rules_evaluate(spark, sf_dir):
    return rules.evaluate(events(spark, sf_dir))


@query(f"select {_FCOLS} from de", _FINDINGS + _DEDUP)
def dedup_findings(spark, sf_dir):
    return rules.dedup(rules_evaluate(spark, sf_dir))


@query("select s.severity, count(de.severity) as findings, round(100.0 * count(de.severity) / greatest((select count(*) from de), 1), 4) as share from (values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity) left join de on de.severity = s.severity group by s.severity", _FINDINGS + _DEDUP)
def agg_severity_counts(spark, sf_dir):
    return rules.severity_counts(dedup_findings(spark, sf_dir))


@query("select severity, tactic, count(*) as findings, count(distinct mitre) as techniques from de group by grouping sets ((severity), (tactic), ())", _FINDINGS + _DEDUP)
def agg_hunt_summary(spark, sf_dir):
    found = dedup_findings(spark, sf_dir)
    return found.groupingSets([["severity"], ["tactic"], []], "severity", "tactic").agg(F.count("*").alias("findings"), F.countDistinct("mitre").alias("techniques"))


_CORR = """select rule_id, rule_name, 'T1110.001' as mitre, 'Credential Access' as tactic, severity, source_ip, invalid as invalid_failures, hosts, accounts, first_seen, last_seen from (
  select *, unnest([case when won > 0 then 1 end, case when real > 0 then 2 end, case when won = 0 and real = 0 then 3 end]) as c from per where invalid >= 5) x,
  lateral (select case c when 1 then 'TH-CORR-001' when 2 then 'TH-CORR-002' else 'TH-CORR-003' end as rule_id, case c when 1 then 'CRITICAL' when 2 then 'HIGH' else 'MEDIUM' end as severity,
    case c when 1 then 'SSH Brute Force — Account Compromised' when 2 then 'SSH Brute Force — Valid Account Targeted' else 'SSH User Enumeration Detected' end as rule_name,
    case c when 1 then won_users when 2 then real_users else '' end as accounts, case c when 1 then last_won when 2 then last_real else last_invalid end as last_seen) y where c is not null"""
_PER = """, per as (select source_ip, count(*) filter (f and i) as invalid, count(*) filter (f and not i) as real, count(*) filter (s) as won,
  coalesce(string_agg(distinct user_name, ', ' order by user_name) filter (s and user_name <> ''), '') as won_users, coalesce(string_agg(distinct user_name, ', ' order by user_name) filter (f and not i and user_name <> ''), '') as real_users,
  coalesce(string_agg(distinct hostname, ', ' order by hostname) filter (f or s), '') as hosts, min(ts) filter (f and i) as first_seen, max(ts) filter (s) as last_won, max(ts) filter (f and not i) as last_real, max(ts) filter (f and i) as last_invalid
  from (select *, coalesce(event_outcome, '') = 'failed' as f, coalesce(event_outcome, '') = 'success' as s,
    lower(trim(user_name)) in ('(invalid user)', '(unknown user)', '(unknown)', 'invalid user', 'unknown user', 'unknown') as i from ev where process_name = 'sshd' or event_category = 'authentication') a group by source_ip)"""


@query(_CORR, _PER)
def corr_bruteforce(spark, sf_dir):
    return rules.bruteforce(events(spark, sf_dir))


@query(f"select rule_id, severity, count(*) as n from (select rule_id, severity from de union all select rule_id, severity from ({_CORR}) c) u group by 1, 2", _FINDINGS + _DEDUP + _PER)
def union_findings(spark, sf_dir):
    both = dedup_findings(spark, sf_dir).unionByName(corr_bruteforce(spark, sf_dir), allowMissingColumns=True)
    return both.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_A = {"id": "a", **_step("eq", "event_outcome", "success")}
_B = {"id": "b", **_step("contains", "commandline", "minidump")}


def _hunt(name: str, relations: list[dict], where: str, previous: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir)
        before = rows.where("hostname = 'host-3'") if previous else None
        ir = {"steps": [_A, _B], "relations": relations, "select": "b", "use_previous": previous}
        return hunt.run_hunt(rows, ir, before, None).select("seq", "hostname", "user_name")

    run.__name__ = name
    query(f"select seq, hostname, user_name from b where {where}", ", a as (select * from ev where event_outcome = 'success'), b as (select * from ev where contains(lower(commandline), 'minidump'))")(run)


_hunt("hunt_same", [{"type": "same", "step": "a", "field": "user_name"}], "user_name <> '' and user_name in (select user_name from a)")
_hunt("hunt_after", [{"type": "after", "step": "a"}], "ts > (select min(ts) from a)")
_hunt("hunt_within", [{"type": "within", "step": "a", "seconds": 600}], "exists (select 1 from a where a.ts between b.ts - interval 600 second and b.ts + interval 600 second)")
_hunt("hunt_entity_within", [{"type": "within", "step": "a", "seconds": 7200, "keys": ["hostname"]}], "exists (select 1 from a where a.hostname = b.hostname and a.ts between b.ts - interval 7200 second and b.ts + interval 7200 second)")
_hunt("hunt_use_previous", [], "hostname = 'host-3'", True)
_hunt("hunt_execute", [{"type": "same", "step": "a", "field": "hostname"}, {"type": "after", "step": "a"}, {"type": "within", "step": "a", "seconds": 3600}], "hostname in (select hostname from a) and ts > (select min(ts) from a) and exists (select 1 from a where a.ts between b.ts - interval 3600 second and b.ts + interval 3600 second)")


@query("select seq, ts, hostname from ev where contains(lower(commandline), 'minidump') order by ts nulls last, seq limit 1000")
def topk_hunt_results(spark, sf_dir):
    return hunt.run_hunt(events(spark, sf_dir), {"steps": [_B], "select": "b"}, most=1000).select("seq", "ts", "hostname")


@query(f"select seq, rule_id, severity from de order by {_RANK} desc, length(commandline) desc, seq, rule_ord limit 15", _FINDINGS + _DEDUP)
def topk_findings(spark, sf_dir):
    return dedup_findings(spark, sf_dir).orderBy(F.desc(F.expr(_RANK)), F.desc(F.length("commandline")), "seq", "rule_ord").limit(15).select("seq", "rule_id", "severity")


@query("select seq, process_name, commandline, hostname, user_name, ts from ev where process_name in ('powershell.exe', 'cmd.exe') and contains(lower(commandline), 'enc') order by ts desc, seq desc limit 100")
def filter_flat_hunt(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.lower("process_name").isin("powershell.exe", "cmd.exe") & F.lower("commandline").contains("enc"))
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(100).select("seq", "process_name", "commandline", "hostname", "user_name", "ts")


@query("select distinct field, value from (" + " union all ".join(f"select '{c}' as field, {c} as value from ev" for c in summaries.FACETS) + ") x where trim(value) <> ''")
def agg_facets(spark, sf_dir):
    return summaries.facets(events(spark, sf_dir))


@query("select field, value, n, first_seq, rank from (select *, row_number() over (partition by field order by n desc, first_seq) as rank from (select field, value, count(*) as n, min(seq) as first_seq from (" + " union all ".join(f"select seq, '{c}' as field, coalesce({c}, 'unknown') as value from ev" for c in ("event_id", "hostname", "user_name")) + ") x group by 1, 2) y) z where rank <= 12")
def agg_top_counts(spark, sf_dir):
    return summaries.top_counts(events(spark, sf_dir))


@query("select lower(parent_process_name) as parent, lower(process_name) as child, count(*) as n, min(seq) as first_seq from ev group by 1, 2 order by n desc, first_seq limit 20")
def agg_process_edges(spark, sf_dir):
    return summaries.process_edges(events(spark, sf_dir))


@query("select commandline, min(seq) as first_seq from ev where length(commandline) >= 20 group by commandline order by first_seq limit 6")
def quick_picks(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.length("commandline") >= 20)
    return rows.groupBy("commandline").agg(F.min("seq").alias("first_seq")).orderBy("first_seq").limit(6)


_IOC = " union ".join(f"select unnest(regexp_extract_all(commandline, {_lit(p)})) as ioc from ev" for p in (summaries.IPV4, summaries.URL))


@query(f"select distinct ioc, not regexp_matches(ioc, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2\\d|3[01])\\.)') as external from ({_IOC}) x")
def ioc_extract(spark, sf_dir):
    return summaries.iocs(events(spark, sf_dir))


_SESSIONS = """, gaps as (select seq, hostname, ts, case when ts - lag(ts) over w <= interval 1 hour then 0 else 1 end as fresh from ev window w as (partition by hostname order by ts, seq)),
 ses as (select *, sum(fresh) over (partition by hostname order by ts, seq) as part from gaps)"""


@query("select seq, hostname, min(seq) filter (fresh = 1) over (partition by hostname, part) as session from ses", _SESSIONS)
def gap_sessions(spark, sf_dir):
    return incidents.gap_sessions(events(spark, sf_dir)).select("seq", "hostname", "session")


@query("select hostname, min(ts) as first_seen, max(ts) as last_seen, arg_min(commandline, seq) as first_command from ev group by hostname")
def first_last_seen(spark, sf_dir):
    return events(spark, sf_dir).groupBy("hostname").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("commandline", "seq").alias("first_command"))


_COMPONENTS = """, links as (select de.seq, 's' || de.hostname || cast(s.session as varchar) as node from de join (select seq, min(seq) over (partition by hostname, part) as session from ses2) s on s.seq = de.seq
 union select seq, 'u' || hostname || user_name from de where user_name <> '' union select seq, 'g' || hostname || process_guid from de where process_guid <> ''),
 reach as (select seq as root, node from links union select reach.root, b.node from reach join links a on a.node = reach.node join links b on b.seq = a.seq),
 inc as (select l.seq, min(r.root) as incident from links l join reach r on r.node = l.node group by l.seq)"""
_DE_SESSIONS = """, gaps2 as (select seq, rule_ord, hostname, ts, case when ts - lag(ts) over w <= interval 1 hour then 0 else 1 end as fresh from de window w as (partition by hostname order by ts, seq, rule_ord)),
 ses2 as (select *, sum(fresh) over (partition by hostname order by ts, seq, rule_ord) as part from gaps2)"""
_ROLLUP = """, ru as (select incident, 'inc_' || cast(sum(cast(('0x' || substr(md5(concat_ws('|', rule_id, hostname, user_name, process_guid, substr(commandline, 1, 120))), 1, 15)) as hugeint)) as varchar) as id,
 max({rank}) as severity_rank, count(*) as finding_count, min(ts) as first_seen, max(ts) as last_seen, string_agg(distinct hostname, '|' order by hostname) as hosts,
 coalesce(string_agg(distinct user_name, '|' order by user_name) filter (user_name <> ''), '') as users, string_agg(distinct tactic, '|' order by tactic) as tactics, string_agg(distinct mitre, '|' order by mitre) as tactic_ids,
 string_agg(distinct rule_id, '|' order by rule_id) as rule_ids, arg_min(tactic, seq * 100 + rule_ord) || ' on ' || arg_min(hostname, seq * 100 + rule_ord) || ' via ' || arg_min(process_name, seq * 100 + rule_ord) as title,
 'P' || cast(least(3, greatest(0, 4 - max({rank}))) as varchar) as priority from di group by incident),
 na as (select incident, string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || rule_name, ' → ' order by n) as steps from (select *, row_number() over (partition by incident order by ts nulls last, seq, rule_ord) as n from di) q where n <= 8 group by incident),
 ro as (select ru.*, steps || case when finding_count > 8 then ' (+' || cast(finding_count - 8 as varchar) || ' more)' else '' end as narrative from ru join na using (incident))""".replace("{rank}", _RANK)
_BY_HOST_DAY = ", di as (select *, cast(seq % 40 as bigint) as incident from de)"


@query(f"select de.seq, rule_id, hostname, incident from de join inc on inc.seq = de.seq", _FINDINGS + _DEDUP + _DE_SESSIONS + _COMPONENTS)
def incident_components(spark, sf_dir):
    return incidents.components(dedup_findings(spark, sf_dir)).select("seq", "rule_id", "hostname", "incident")


@query("select de.seq, rule_id, hostname, incident from de join inc on inc.seq = de.seq", _FINDINGS + _DEDUP + _DE_SESSIONS + _COMPONENTS)
def incident_components_by_steps(spark, sf_dir):
    """The same components from findings that come in three parts, not in their order."""
    from .operators.shared import Scratch

    found = Scratch(spark, "parts").keep(dedup_findings(spark, sf_dir), "findings")
    nodes, spans = spark.createDataFrame([], incidents.NODES), spark.createDataFrame([], incidents.SPANS)
    for part in (2, 0, 1):
        nodes, spans = incidents.advance(found.where(f"seq % 3 = {part}"), nodes, spans, Scratch(spark, "advance"))
    return found.join(incidents.placed(nodes), "seq").select("seq", "rule_id", "hostname", "incident")


def _grouped(spark, sf_dir):
    """Findings under incident numbers that SQL can give as well; incidents_build has the real ones."""
    return dedup_findings(spark, sf_dir).withColumn("incident", F.expr("cast(seq % 40 as bigint)"))


@query("select * from ro", _FINDINGS + _DEDUP + _BY_HOST_DAY + _ROLLUP)
def agg_incident_rollup(spark, sf_dir):
    return incidents.rollup(_grouped(spark, sf_dir))


@query("select incident, severity_rank, finding_count from ro order by severity_rank desc, finding_count desc, incident", _FINDINGS + _DEDUP + _BY_HOST_DAY + _ROLLUP)
def sort_incidents(spark, sf_dir):
    return incidents.ranked(incidents.rollup(_grouped(spark, sf_dir))).select("incident", "severity_rank", "finding_count")


_TRIAGE = """, tl as (select seq % 60 as incident_id, seq, case seq % 5 when 0 then 'remediated' when 1 then 'pending_fix' when 2 then 'excluded' end as status,
 case when seq % 7 = 0 then 'P' || cast(seq % 4 as varchar(1)) end as priority, case when seq % 3 = 0 then 'note ' || cast(seq as varchar(20)) end as note from ev where seq % 97 = 0 or seq % 60 in (7, 8)),
 ts0 as (select incident_id, arg_max(status, seq) filter (status is not null) as status, arg_max(priority, seq) filter (priority is not null) as priority, arg_max(note, seq) filter (note is not null) as note from tl group by 1),
 tm as (select ro.incident, coalesce(ts0.status, 'new') as status, coalesce(ts0.priority, ro.priority) as priority, coalesce(ts0.note, '') as note, finding_count from ro left join ts0 on ts0.incident_id = ro.incident)"""


def _triaged(spark, sf_dir):
    log = events(spark, sf_dir).where("seq % 97 = 0 or seq % 60 in (7, 8)").selectExpr(
        "seq % 60 as incident_id", "seq", "case seq % 5 when 0 then 'remediated' when 1 then 'pending_fix' when 2 then 'excluded' end as status",
        "case when seq % 7 = 0 then 'P' || cast(seq % 4 as varchar(1)) end as priority", "case when seq % 3 = 0 then 'note ' || cast(seq as varchar(20)) end as note")
    return incidents.triage_merge(incidents.rollup(_grouped(spark, sf_dir)), log)


@query("select * from tm", _FINDINGS + _DEDUP + _BY_HOST_DAY + _ROLLUP + _TRIAGE)
def triage_merge(spark, sf_dir):
    return _triaged(spark, sf_dir).select("incident", "status", "priority", "note", "finding_count")


@query("""select count(*) as total, count(*) filter (o) as open, count(*) filter (not o) as closed, count(*) filter (o and priority = 'P0') as p0, count(*) filter (o and priority = 'P1') as p1,
 count(*) filter (o and priority = 'P2') as p2, count(*) filter (o and priority = 'P3') as p3 from (select *, status not in ('remediated', 'excluded', 'risk_accepted') as o from tm) x""", _FINDINGS + _DEDUP + _BY_HOST_DAY + _ROLLUP + _TRIAGE)
def agg_incident_stats(spark, sf_dir):
    return incidents.stats(_triaged(spark, sf_dir))


@query("select i.* from ro i", _FINDINGS + _DEDUP + _DE_SESSIONS + _COMPONENTS + ", di as (select de.*, inc.incident from de join inc on inc.seq = de.seq)" + _ROLLUP)
def incidents_build(spark, sf_dir):
    found = dedup_findings(spark, sf_dir)
    return incidents.rollup(incidents.components(found))


_REAL = ", di as (select de.*, inc.incident from de join inc on inc.seq = de.seq)"
_TRIAGE_REAL = _TRIAGE.replace("select seq % 60 as incident_id", "select incident as incident_id").replace("from ev where seq % 97 = 0 or seq % 60 in (7, 8)", "from di where seq % 3 = 0")


@query("select incident, status, priority, note, finding_count from tm", _FINDINGS + _DEDUP + _DE_SESSIONS + _COMPONENTS + _REAL + _ROLLUP + _TRIAGE_REAL)
def incidents_triaged(spark, sf_dir):
    """Triage given through every third finding of an incident meets the incidents themselves."""
    found = incidents.components(dedup_findings(spark, sf_dir))
    log = found.where("seq % 3 = 0").selectExpr(
        "incident as incident_id", "seq", "case seq % 5 when 0 then 'remediated' when 1 then 'pending_fix' when 2 then 'excluded' end as status",
        "case when seq % 7 = 0 then 'P' || cast(seq % 4 as varchar(1)) end as priority", "case when seq % 3 = 0 then 'note ' || cast(seq as varchar(20)) end as note")
    return incidents.triage_merge(incidents.rollup(found), log).select("incident", "status", "priority", "note", "finding_count")


_EDGES = """, ed as (select source, target, type, arg_min(label, seq) as label, min(seq) as first_seq from (
 select parent_process_guid as source, process_guid as target, 'SPAWNED' as type, process_name as label, seq from ev where parent_process_guid <> process_guid
 union all select process_guid, 'net-' || destination_ip || ':' || coalesce(destination_port, ''), 'CONNECTED', destination_port, seq from ev where destination_ip <> '' and (event_id in ('3', '5156') or event_category = 'network_connection')) x group by 1, 2, 3)"""


@query("select source, target, type, label from ed", _EDGES)
def graph_edges(spark, sf_dir):
    return graph.edges(events(spark, sf_dir)).select("source", "target", "type", "label")


def _edges(spark, sf_dir):
    return graph.edges(events(spark, sf_dir))


_NODES = f""", own as (select process_guid as id, 'process' as type, arg_min(process_name, seq) as label, arg_min(hostname, seq) as hostname, arg_min(user_name, seq) as user_name, arg_min(commandline, seq) as commandline, count(*) as events, min(seq) as first_seq from ev group by process_guid),
 nd as (select * from own union all select parent_process_guid, 'process', arg_min(parent_process_name, seq), arg_min(hostname, seq), null, null, 0, min(seq) from ev where parent_process_guid <> process_guid and parent_process_guid not in (select id from own) group by 1
 union all select 'net-' || destination_ip || ':' || coalesce(destination_port, ''), 'network', destination_ip || ':' || coalesce(destination_port, ''), arg_min(hostname, seq), null, null, count(*), min(seq) from ev where destination_ip <> '' and (event_id in ('3', '5156') or event_category = 'network_connection') group by 1, 3),
 nm as (select nd.*, coalesce(m.r, 0) as severity_rank, coalesce(m.rules, '') as rules, coalesce(m.techniques, '') as techniques from nd left join (select process_guid, max({_RANK}) as r, string_agg(distinct rule_id, '|' order by rule_id) as rules, string_agg(distinct mitre, '|' order by mitre) as techniques from de group by 1) m on m.process_guid = nd.id)"""


def _nodes(spark, sf_dir):
    return graph.nodes(events(spark, sf_dir), dedup_findings(spark, sf_dir))


@query("select * from nm", _FINDINGS + _DEDUP + _NODES)
def agg_graph_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


_TOP = ", kept as (select id from nm order by severity_rank desc, first_seq, id limit 300), shown as (select * from nm where id in (select id from kept) or id in (select source from ed where target in (select id from kept)))"


_INNER = ", inner_ed as (select * from ed where source in (select id from shown) and target in (select id from shown))"


@query("select * from shown", _FINDINGS + _DEDUP + _NODES + _EDGES + _TOP)
def topk_graph(spark, sf_dir):
    return graph.top(_nodes(spark, sf_dir), graph_edges(spark, sf_dir), 300)


@query("""select (select count(*) from nm) as nodes, count(*) as displayed, count(*) filter (severity_rank = 4) as critical, count(*) filter (severity_rank = 3) as high, count(*) filter (severity_rank = 2) as medium,
 (select count(*) from ed) as edges, (select count(*) from ed where type = 'SPAWNED') as spawned, (select count(*) from ed where type = 'CONNECTED') as connected, least(200, (select count(*) from inner_ed)) as displayed_edges,
 count(*) < (select count(*) from nm) or (select count(*) from inner_ed) > 200 as truncated from shown""", _FINDINGS + _DEDUP + _NODES + _EDGES + _TOP + _INNER)
def graph_stats(spark, sf_dir):
    return graph.stats(_nodes(spark, sf_dir), _edges(spark, sf_dir), 300, 200)


@query("select source, target, type, label from inner_ed order by first_seq, source, target, type limit 200", _FINDINGS + _DEDUP + _NODES + _EDGES + _TOP + _INNER)
def topk_graph_edges(spark, sf_dir):
    """The edges shown with a graph that was cut: both ends are, and they are the first."""
    edges = _edges(spark, sf_dir)
    return graph.top_edges(graph.top(_nodes(spark, sf_dir), edges, 300), edges, 200).select("source", "target", "type", "label")


_TREE = _EDGES + """, up as (select target as node, arg_min(source, first_seq) as parent from (select source, target, min(seq) as first_seq from (
   select parent_process_guid as source, process_guid as target, seq from ev where parent_process_guid <> process_guid) x group by 1, 2) y group by 1),
 walk as (select parent as root, parent as node, 0 as depth, [parent] as path from (select distinct parent from up where parent not in (select node from up)) r
   union all select walk.root, up.node, walk.depth + 1, list_append(walk.path, up.node) from walk join up on up.parent = walk.node)"""


@query("""select root, walk.node, up.parent, depth, array_to_string(path, '|') as path, coalesce(c.n, 0) as children, false as on_cycle from walk left join up on up.node = walk.node
 left join (select parent as node, count(*) as n from up group by 1) c on c.node = walk.node""", _TREE)
def process_tree(spark, sf_dir):
    return graph.tree(_edges(spark, sf_dir)).withColumn("path", F.array_join("path", "|"))


@query("select source, count(distinct target) as destinations from ed where type = 'CONNECTED' group by source", _EDGES)
def node_connections(spark, sf_dir):
    return graph_edges(spark, sf_dir).where("type = 'CONNECTED'").groupBy("source").agg(F.countDistinct("target").alias("destinations"))


@query("select process_guid, parent_process_guid, seq, row_number() over (partition by parent_process_guid order by ts, seq) as child_rank from ev")
def tree_child_rank(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("parent_process_guid").orderBy("ts", "seq")
    return events(spark, sf_dir).select("process_guid", "parent_process_guid", "seq", F.row_number().over(order).alias("child_rank"))


_TIMELINE = f""", byp as (select process_guid, max({_RANK}) as r, string_agg(distinct rule_id, '|' order by rule_id) as rules from de group by 1),
 bys as (select source_ip, max({_RANK}) as r, string_agg(distinct rule_id, '|' order by rule_id) as rules from ({_CORR}) c group by 1),
 tline as (select ev.seq, hostname, process_name, greatest(coalesce(byp.r, 0), coalesce(bys.r, 0)) as severity_rank, concat_ws('|', byp.rules, bys.rules) as rules from ev left join byp on byp.process_guid = ev.process_guid left join bys on bys.source_ip = ev.source_ip)"""


def _timeline(spark, sf_dir):
    return summaries.enrich_timeline(events(spark, sf_dir), dedup_findings(spark, sf_dir), corr_bruteforce(spark, sf_dir))


@query("select seq, severity_rank, rules from tline", _FINDINGS + _DEDUP + _PER + _TIMELINE)
def enrich_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir).select("seq", "severity_rank", "rules")


@query("select seq, severity_rank from tline where hostname = 'host-3' and process_name = 'cmd.exe' and severity_rank > 0", _FINDINGS + _DEDUP + _PER + _TIMELINE)
def filter_timeline(spark, sf_dir):
    return summaries.filter_timeline(_timeline(spark, sf_dir), host="host-3", process="cmd.exe", severity="malicious").select("seq", "severity_rank")


_FEEDBACK = FEEDBACK_SQL + """, fb as (select * exclude (corrected_severity), 'fb_' || substr(sha1(concat_ws(chr(31), commandline, process_name, event_id, hostname)), 1, 16) as id, coalesce(corrected, case when agree then verdict else not verdict end) as label,
 case when analyst in ('analyst-1', 'analyst-3') then 1.0::double else 0.5::double end as trust, least(greatest(corrected_severity, 1), 10) as corrected_severity from fb0)"""


def _feedback(spark, sf_dir):
    return verdicts.feedback(feedback(spark, sf_dir), TRUSTED)


@query("select seq, label, trust, case when corrected_severity is null then -1 else corrected_severity end as severity from fb", _FEEDBACK)
def feedback_label(spark, sf_dir):
    return _feedback(spark, sf_dir).select("seq", "label", "trust", F.coalesce("corrected_severity", F.lit(-1)).alias("severity"))


@query("select seq, id from fb", _FEEDBACK)
def feedback_fingerprint(spark, sf_dir):
    return _feedback(spark, sf_dir).select("seq", "id")


_DISPUTED = ", dis as (select id from fb where trust >= 0.9 and label is not null group by id having count(distinct label) > 1)"


@query("select id from dis", _FEEDBACK + _DISPUTED)
def feedback_disputed(spark, sf_dir):
    return verdicts.disputed(_feedback(spark, sf_dir))


def _embed_sql(name: str, source: str) -> str:
    """Sparse embeddings of the texts of a table, as {name}(text, idx, w)."""
    byte = "cast('0x' || substr(md5(g), {}, 2) as int)"
    return f""", {name}g as (select text, substr(low, cast(i as bigint), 3) as g from (select *, unnest(range(1, length(low) - 1)) as i from (select text, case when length(text) < 3 then rpad(lower(text), 3, ' ') else lower(text) end as low from (select distinct text from {source}) q0) q1) q),
 {name}s as (select text, {byte.format(31)} as idx, sum(case when {byte.format(29)} % 2 = 1 then 1 else -1 end)::double as w from {name}g group by 1, 2 having sum(case when {byte.format(29)} % 2 = 1 then 1 else -1 end) <> 0),
 {name} as (select text, idx, w / sqrt(sum(w * w) over (partition by text)) as w from {name}s)"""


_EMBEDDED = _embed_sql("emb", "(select commandline as text from ev)")


@query("select text, idx, round(w, 6) as w from emb", _EMBEDDED)
def embed_hash(spark, sf_dir):
    return summaries.embed(events(spark, sf_dir), "commandline").withColumn("w", F.round("w", 6))


_CORPUS = ", cor as (select * from (values " + ", ".join(f"({i}, {_lit(t)}, {_lit(label) if label else 'null'})" for i, (t, label) in enumerate((*vectors.KNOWN_BAD, *((b, None) for b in vectors.BENIGN)))) + ") c(corpus_id, text, label))"
_SCORES = _EMBEDDED + _CORPUS + _embed_sql("cem", "cor") + """, sc as (select t.text, cor.corpus_id, cor.label, round(coalesce(sum(emb.w * cem.w), 0), 9) as score from (select distinct commandline as text from ev) t, cor
 left join emb on emb.text = t.text left join cem on cem.text = cor.text and cem.idx = emb.idx group by 1, 2, 3)"""


@query("""select text, round(b, 4) as bad_score, round(g, 4) as benign_score, b >= 0.3 as like_bad, case when b >= 0.3 then l end as family, round(1 - g, 4) as novelty from (
 select text, max(score) filter (label is not null) as b, max(score) filter (label is null) as g, arg_max(label, score * 1000000 - corpus_id) filter (label is not null) as l from sc group by text) x""", _SCORES)
def knn_known_bad(spark, sf_dir):
    per = vectors.known_bad(summaries.embed(events(spark, sf_dir), "commandline"), lambda rows: summaries.embed(rows.select("text"), "text"))[1]
    return per.withColumns({c: F.round(c, 4) for c in ("bad_score", "benign_score", "novelty")})


_FEWSHOT = _EMBEDDED + _DISPUTED + """, good as (select id, arg_min(commandline, seq) as commandline, arg_min(label, seq) as label, min(seq) as seq from fb where trust >= 0.9 and label is not null and id not in (select id from dis) group by id),
 sims as (select a.text as commandline, b.text as other, round(sum(a.w * b.w), 9) as s from emb a join emb b on a.idx = b.idx group by 1, 2),
 fs as (select * from (select sims.commandline, id, label, s as similarity, row_number() over (partition by sims.commandline order by s desc, seq) as rank from sims join good on good.commandline = other where s >= 0.45) x where rank <= 3)"""


def _fewshot(spark, sf_dir):
    shown = _feedback(spark, sf_dir)
    return vectors.fewshot(events(spark, sf_dir).select("commandline"), shown, verdicts.disputed(shown), lambda rows: summaries.embedded(rows, "commandline"))


@query("select commandline, cast(rank as int) as rank, id, label, round(similarity, 4) as similarity from fs", _FEEDBACK + _FEWSHOT)
def fewshot_retrieve(spark, sf_dir):
    return _fewshot(spark, sf_dir).select("commandline", "rank", "id", "label", F.round("similarity", 4).alias("similarity"))


@query("select label, count(*) as vectors, round(avg(list_dot_product(embedding::double[], embedding::double[])), 4) as mean_square from embeddings group by label")
def vector_norms(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg(square), 4).alias("mean_square"))


def _uuid5_sql(seed: str) -> str:
    digest = f"sha1(unhex('{DNS_NAMESPACE}') || encode({seed}))"
    return f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"


@query("select seq, " + _uuid5_sql("hostname || '-' || process_name || '-' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '-' || commandline") + " as guid, " + _uuid5_sql("hostname || '-' || parent_process_name || '-parent'") + " as parent_guid from ev")
def norm_guid(spark, sf_dir):
    guid = process_guid(F.col("hostname"), F.col("process_name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("commandline"))
    return events(spark, sf_dir).select("seq", guid.alias("guid"), parent_guid(F.col("hostname"), F.col("parent_process_name")).alias("parent_guid"))


@query("""select seq, hostname, user_name, case when contains(lower(properties), '1131f6aa-9c07-11d1-f79f-00c04fc2dcd2') then 'DS-Replication-Get-Changes' else 'DS-Replication-Get-Changes-In-Filtered-Set' end as matched_right, 10 as severity
 from ev where event_id = '4662' and (contains(lower(properties), '1131f6aa-9c07-11d1-f79f-00c04fc2dcd2') or contains(lower(object_guid), '89e95b76-444d-4c62-991a-0facbeda640c'))""")
def agg_dcsync(spark, sf_dir):
    return verdicts.replication_rights(events(spark, sf_dir))


_EXCLUDED = "user_name = 'invalid user' or source_ip = '10.0.0.4'"


@query(f"""select incident, finding_count, active_finding_count, severity_rank, active_finding_count = 0 as all_excluded, 'P' || cast(least(3, greatest(0, 4 - severity_rank)) as varchar) as priority from (
    select hostname as incident, count(*) as finding_count, count(*) filter (not ({_EXCLUDED})) as active_finding_count,
    coalesce(max({_RANK}) filter (not ({_EXCLUDED})), max({_RANK})) as severity_rank from de group by hostname) x""", _FINDINGS + _DEDUP)
def exclude_findings(spark, sf_dir):
    found = dedup_findings(spark, sf_dir).withColumn("incident", F.col("hostname"))
    return verdicts.exclude_findings(found, found.where(_EXCLUDED))


@query(f"""select item, cast(ord as int) as ord, value from (
    select 'overall_severity' as item, 1 as ord, ['clean', 'low', 'medium', 'high', 'critical'][coalesce(max({_RANK}), 0) + 1] as value from de
    union all select 'attack_stage', 1, coalesce(max(tactic), 'None') from de
    union all select 'findings', 1, cast(count(*) as varchar) from de
    union all select 'critical', 1, cast(count(*) filter (severity = 'CRITICAL') as varchar) from de
    union all select 'host', 1, hostname from (select distinct hostname from de where hostname <> '') h
    union all select 'user', 1, user_name from (select distinct user_name from de where user_name <> '') u
    union all select 'technique ' || mitre, 1, arg_max(rule_name, seq * 1000 + rule_ord) from de where regexp_full_match(mitre, 'T[0-9]{{4}}([.][0-9]{{3}})?') group by mitre
    union all select 'key finding', row_number() over (order by {_RANK} desc, seq, rule_ord), rule_name || ' on ' || hostname || ' by ' || user_name from (select * from de order by {_RANK} desc, seq, rule_ord limit 8) k
    ) x""", _FINDINGS + _DEDUP)
def agg_session_summary(spark, sf_dir):
    return verdicts.session_summary(dedup_findings(spark, sf_dir))


@query("""select hostname as incident_id, arg_max(event_outcome, seq) filter (event_outcome is not null) as status,
    arg_max(target_image, seq) filter (target_image is not null) as note, max(seq) as seq from ev group by hostname""")
def latest_triage(spark, sf_dir):
    log = events(spark, sf_dir).select(F.col("hostname").alias("incident_id"), "seq", F.col("event_outcome").alias("status"), F.col("target_image").alias("note"))
    newest = log.groupBy("incident_id").agg(F.max("seq").alias("seq"))
    return incidents.latest_triage(log).join(newest, "incident_id")


_MATCHED = ", m as (select distinct process_guid as node from ev where process_name = 'powershell.exe' and hostname = 'host-3')"


def _matched(spark, sf_dir):
    return events(spark, sf_dir).where("process_name = 'powershell.exe' and hostname = 'host-3'").select(F.col("process_guid").alias("node")).distinct()


@query("select node from m union select target from ed join m on source = node union select source from ed join m on target = node", _EDGES + _MATCHED)
def filter_graph_ego(spark, sf_dir):
    return graph.ego(graph_edges(spark, sf_dir), _matched(spark, sf_dir))


@query("select node from up union select target from ed join up on source = node and type = 'SPAWNED'", _EDGES + _MATCHED + ", up as (select node from m union select source from ed join up on target = node and type = 'SPAWNED')")
def filter_tree_ancestors(spark, sf_dir):
    return graph.with_ancestors(graph_edges(spark, sf_dir), _matched(spark, sf_dir))


def _share(text: str) -> str:
    return f"(length(regexp_replace({text}, '[^ -~\\t\\r\\n]', '', 'g')) / length({text}))"


_ARGUMENT = f"regexp_extract(commandline, {_lit(decode.ARGUMENT)}, 1)"
#: The hidden text of a command, for UTF-16 of ASCII characters and UTF-8 alone.
_DECODED = f""", dc0 as (select commandline, list_concat(case when {_ARGUMENT} <> '' then [{_ARGUMENT}] else [] end, regexp_extract_all(commandline, {_lit(decode.BLOB)})) as blobs from (select distinct commandline from ev where commandline is not null) q),
 dc1 as (select commandline, unnest(blobs) as b, generate_subscripts(blobs, 1) as i from dc0), dc2 as (select commandline, i, case when length(b) % 4 = 0 then hex(try(from_base64(b))) end as h from dc1),
 dc3 as (select commandline, i, 1 as k, 'utf-16-le' as layer, decode(unhex(regexp_replace(h, '(..)00', '\\1', 'g'))) as t from dc2 where regexp_full_match(h, '(..00)+')
 union all select commandline, i, 2, 'utf-8', replace(try(decode(unhex(h))), chr(0), '') from dc2),
 dc as (select commandline, t as decoded, layer from (select *, row_number() over (partition by commandline order by i, {_share('t')} desc, k) as rn from dc3 where length(t) >= {decode.LEAST} and {_share('t')} >= {decode.PLAIN}) q where rn = 1)"""


@query("select commandline, decoded, layer, len(list_distinct(blobs)) as candidates from dc0 left join dc using (commandline)", _DECODED)
def decode_commands(spark, sf_dir):
    return decode.decode_commands(events(spark, sf_dir))


#: The argument's pattern asks for 16 characters of base64, which 10 bytes give.
_WHOLE = "case when kind = 'utf-8' then strlen(text) else 2 * length(text) end >= 10 and " + _share("text") + " >= 0.85"


@query(f"select kind, count(*) as commands, count(*) filter ({_WHOLE}) as decoded, sum(case when {_WHOLE} then length(text) else 0 end)::bigint as chars, count(distinct case when {_WHOLE} then md5(text) end) as texts from (select distinct text, case when text = '' then 'utf-8' when doc_id % 2 = 0 then 'utf-16-le' else 'utf-8' end as kind from documents where text is not null) q group by kind")
def decode_hidden(spark, sf_dir):
    """Every whole text of documents hidden in a command, in UTF-16 or UTF-8, and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    kind = F.when((F.col("doc_id") % 2 == 0) & (F.col("text") != ""), "utf-16-le").otherwise("utf-8").alias("kind")
    rows = docs.select("text", kind).distinct()
    raw = F.when(F.col("kind") == "utf-8", F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE"))
    rows = rows.select("text", "kind", F.concat(F.lit("powershell -enc "), F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))).alias("commandline"))
    found = decode.decoded(rows)  # distinct texts of a kind make distinct commands
    right = (F.col("decoded") == F.col("text")) & (F.col("layer") == F.col("kind"))
    return found.groupBy("kind").agg(
        F.count("*").alias("commands"), F.count_if(right).alias("decoded"), F.sum(F.when(right, F.length("text")).otherwise(0)).alias("chars"),
        F.count_distinct(F.when(right, F.md5("text"))).alias("texts"),
    )


@query("""select query_id, cast(rank as int) as rank, neighbour_id, round(similarity, 4) as similarity from (
    select *, row_number() over (partition by query_id order by similarity desc, neighbour_id) as rank from (
    select q.vec_id as query_id, v.vec_id as neighbour_id, coalesce(round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9), 0) as similarity
    from embeddings q join embeddings v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id) x) y where rank <= 5""")
def knn_dense(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.knn_dense(rows, rows.where("vec_id % 50 = 0")).withColumn("similarity", F.round("similarity", 4))


def _hit_sql(text: str, is_4662: str) -> str:
    rights = [f"case when {is_4662} and contains(lower({text}), '{g}') then {{'i': {_lit('DCSync GUID: ' + n)}, 's': 10, 't': 'T1003.006'}} end" for g, n in verdicts.REPLICATION_RIGHTS.items()]
    checks = [f"case when regexp_matches({text}, {_lit(p)}) then {{'i': {_lit(i)}, 's': {v}, 't': '{t}'}} end" for p, i, v, t in heuristics.CHECKS]
    return f"[x for x in [{', '.join(rights + checks)}] if x is not null]"


_SEMANTICS = f""", act as (select distinct {_ACTIVITY} as activity, coalesce(event_id = '4662', false) as is_4662 from ev), hit as (select activity, is_4662, {_hit_sql('activity', 'is_4662')} as hits from act),
 sem as (select ev.*, coalesce(list_max([h.s for h in hits]), 1) as sev, [h.t for h in hits] as techs, [h.i for h in hits] as inds from ev join hit on hit.activity = {_ACTIVITY} and hit.is_4662 = coalesce(ev.event_id = '4662', false))"""
_TECHS = "array_to_string(list_sort(list_distinct(techs)), '|')"


def _joined(column: str, ordered: bool = False):
    return F.array_join(F.col(column) if ordered else F.array_sort(column), "|").alias(column)


@query(f"select seq, sev as severity, {_TECHS} as techniques, array_to_string(inds, '|') as indicators from sem", _SEMANTICS)
def agg_event_semantics(spark, sf_dir):
    return heuristics.event_semantics(events(spark, sf_dir)).select("seq", "severity", _joined("techniques"), _joined("indicators", True))


_NUMBER = "case severity when 'CRITICAL' then 10 when 'HIGH' then 8 when 'MEDIUM' then 5 else 3 end"


@query(f"""select seq, greatest(sev, coalesce(n, 1)) as severity, concat_ws('|', nullif(array_to_string(inds, '|'), ''), names) as indicators from sem left join (
 select seq as q, max({_NUMBER}) as n, string_agg('Rule match: ' || rule_name, '|' order by rule_ord) filter ({_NUMBER} >= 8) as names from fi group by seq) r on r.q = sem.seq""", _SEMANTICS + _FINDINGS)
def rule_escalation(spark, sf_dir):
    rows = events(spark, sf_dir)
    return heuristics.escalate(heuristics.event_semantics(rows), rules.evaluate(rows)).select("seq", "severity", _joined("indicators", True))


@query("select seq, event_id, case event_id " + " ".join(f"when '{k}' then {_lit(v)}" for k, v in heuristics.EVENT_NOTES.items()) + " end as note from ev where event_id in (" + ", ".join(f"'{k}'" for k in heuristics.EVENT_NOTES) + ")")
def eid_context(spark, sf_dir):
    return heuristics.event_notes(events(spark, sf_dir)).select("seq", "event_id", "note").where("note is not null")


@query("select seq, sev as severity from sem where sev >= 5 order by sev desc, seq limit 100", _SEMANTICS)
def topk_semantic_hits(spark, sf_dir):
    return heuristics.semantic_hits(heuristics.event_semantics(events(spark, sf_dir))).select("seq", "severity")


_TACTIC = "case split_part(t, '.', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in severity.TACTICS.items()) + " end"
_COUNTS = " union all ".join(f"select '{c}' as field, coalesce({c}, 'unknown') as value, seq from ev" for c in ("event_id", "hostname", "user_name"))


def _right_sql(text: str) -> str:
    return "coalesce(" + ", ".join(f"case when contains(lower({text}), '{g}') then {_lit(n)} end" for g, n in verdicts.REPLICATION_RIGHTS.items()) + ")"


_BY_CONTEXT = f"case when event_id = '4662' then coalesce(case when contains(lower(properties), 'replication') then properties end, {_right_sql("concat_ws(' ', properties, object_guid)")}) end"
_SIGNS = "['AD Replication right: ' || mr, 'EID 4662 triggered by non-DC account', 'Actor: ' || coalesce(user_name, 'unknown') || ' (should be a DC machine account)']"
_PRE = f""", pr as (select seq, case when mr is not null then 10 else sev end as sev, case when mr is not null then ['T1003.006'] else techs end as techs, case when mr is not null then {_SIGNS} else inds end as inds
 from (select *, coalesce({_right_sql(_ACTIVITY)}, {_BY_CONTEXT}) as mr from sem) m), hi as (select * from pr where sev >= 5),
 ph as (select value, count(distinct seq) as n from (select seq, {_TACTIC} as value from (select seq, unnest(techs) as t from hi) b0) b where value is not null group by value),
 steps as (select 0 as o, case when exists (select 1 from hi) then {_lit(heuristics.SOMETHING)} else {_lit(heuristics.NOTHING)} end as step
 {" ".join(f"union all select {i + 1}, {_lit(step)} where {_lit(p)} in (select value from ph)" for i, (p, step) in enumerate(heuristics.PHASE_STEPS.items()))})"""


@query(f"""select 'overall_severity' as item, 1 as ord, case when m >= 9 then 'critical' when m >= 7 then 'high' when m >= 5 then 'medium' else 'clean' end as value, n from (select coalesce(max(sev), 1) as m, count(*) as n from hi) a
 union all select 'phase', 1, value, n from ph
 union all select 'next_step', cast(row_number() over (order by o) as int), step, 1 from steps
 union all select 'finding', cast(row_number() over (order by sev desc, seq) as int), seq || ' ' || array_to_string(inds, '; '), sev from (select * from hi order by sev desc, seq limit 100) f
 union all select 'timeline', cast(row_number() over (order by ts, seq) as int), concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), process_name, hostname, event_id), 1 from (select * from ev where ts is not null order by ts, seq limit 200) t
 union all select 'top ' || field, cast(rank as int), value, n from (select *, row_number() over (partition by field order by n desc, f) as rank from (select field, value, count(*) as n, min(seq) as f from ({_COUNTS}) c0 group by 1, 2) c1) c where rank <= 12
 union all select 'process edge', 1, parent || ' > ' || child, n from (select lower(parent_process_name) as parent, lower(process_name) as child, count(*) as n, min(seq) as f from ev group by 1, 2 order by n desc, f limit 20) d""", _SEMANTICS + _PRE)
def agg_prescan(spark, sf_dir):
    return heuristics.prescan(events(spark, sf_dir), None)


_CONTEXT = ", ".join(heuristics.CONTEXT)
_STEERS = " or ".join(f"coalesce(regexp_matches({c}, {_lit(predicates.MARKERS)}), false)" for c in ("commandline", *heuristics.CONTEXT))
_COMMANDS = _DECODED + f""", ct as (select commandline, decoded, layer, concat_ws(chr(10) || '# decoded:' || chr(10), commandline, decoded) as txt from (select distinct commandline from ev) q left join dc using (commandline)),
 ch as (select *, {_hit_sql('txt', 'false')} as hits, {_right_sql('txt')} as rt from ct),
 cx as (select ev.commandline, {", ".join("ev." + c for c in heuristics.CONTEXT)}, coalesce(max({_NUMBER.replace("else 3", "when 'LOW' then 3")}), 1) as n,
 coalesce(list_sort(list_distinct(list({{'o': rule_ord, 'n': 'Rule match: ' || rule_name}}) filter ({_NUMBER} >= 8))), []) as names from ev left join fi on fi.seq = ev.seq group by all),
 s0 as (select cx.*, decoded, layer, hits, coalesce(rt, {_BY_CONTEXT}) as mr, greatest(n, case when event_id = '4662' and rt is not null then 10 else coalesce(list_max([h.s for h in hits]), 1) end) as heuristic from cx join ch using (commandline)),
 s1 as (select *, case when mr is not null then 10 else heuristic end as severity, case when mr is not null then ['T1003.006'] else [h.t for h in hits] end as techs,
 case when mr is not null then {_SIGNS} else list_concat([h.i for h in hits], [x.n for x in names]) end as inds, case when mr is not null then 'dcsync' else 'heuristic' end as source from s0),
 s2 as (select *, severity >= 5 as is_malicious, (severity >= 5) = (heuristic >= 5) as agree, severity >= 7 or heuristic >= 7 as strong, severity <= 2 and len(inds) = 0 as benign from s1),
 sc as (select *, not agree or not (strong or benign) as abstained, round(least(case when agree then 1.0 else 0.45 end, case when strong then least(0.95, 0.7 + 0.05 * len(inds)) when benign then 0.7 else 0.4 end), 2)::double as confidence from s2)"""


def _commands(spark, sf_dir):
    rows = events(spark, sf_dir)
    return heuristics.score_commands(rows, rules.evaluate(rows))


@query(f"select commandline, {_CONTEXT}, decoded, layer, mr as matched_right, source, severity, heuristic, is_malicious, {_TECHS} as techniques, array_to_string(inds, '|') as indicators, confidence, abstained, mr is null and ({_STEERS}) as degraded from sc", _FINDINGS + _COMMANDS)
def score_commands(spark, sf_dir):
    columns = ("decoded", "layer", "matched_right", "source", "severity", "heuristic", "is_malicious", "confidence", "abstained", "degraded")
    return _commands(spark, sf_dir).select("commandline", *heuristics.CONTEXT, *columns, _joined("techniques"), _joined("indicators", True))


_SHOWN = ", sh as (select seq, sev as severity, hostname as host, user_name, technique from (select *, unnest(list_distinct(techs)) as technique from sem where sev >= 5) q), nw as (select * from sh where (technique, host) not in (select mitre, hostname from de))"
_EVIDENCE = " union all ".join(
    f"select '{t}' as technique, count(*) filter (" + " or ".join(
        {"regex": lambda f, v: _search(f, v), "contains": lambda f, v: f"coalesce(contains(lower({f}), {_lit(v)}), false)", "eq": lambda f, v: f"coalesce(lower({f}) = {_lit(v)}, false)"}[o](f, v) for f, o, v in tests
    ) + ") as evidence from ev" for t, tests in heuristics.EVIDENCE.items()
)


def _hunt_sql() -> str:
    import json

    whens = " ".join(f"when {_lit(t)} then {_lit(json.dumps(heuristics.validation_hunt(t)))}" for t in heuristics.EVIDENCE)
    return f"case technique {whens} else replace({_lit(json.dumps(heuristics.validation_hunt('$')))}, '$', technique) end"


@query(f"""select technique, severity, host, user_name, seq, 'hyp_' || (row_number() over (order by severity desc, seq, technique) - 1) as id,
 'Suspected ' || technique || ' activity on ' || coalesce(nullif(host, ''), 'a host') || coalesce(' by ' || nullif(user_name, ''), '') || ' — not yet matched by a detection rule.' as hypothesis,
 'Suspected (no rule match): ' || signs || ' (severity ' || severity || ').' as rationale, {_hunt_sql()} as validation_query,
 coalesce(e.evidence, (select count(*) from ev where process_name <> '')) as evidence, case when severity >= 9 then 0.9::double when severity >= 7 then 0.75::double when severity >= 5 then 0.55::double else 0.4::double end as confidence
 from (select * from (select *, row_number() over (partition by technique order by severity desc, seq) as rn from (
 select pr.seq, sev as severity, hostname as host, user_name, array_to_string(inds[1:3], ', ') as signs, unnest(list_distinct(techs)) as technique from pr join ev on ev.seq = pr.seq where sev >= 5) s
 where (technique, host) not in (select mitre, hostname from de)) q where rn = 1 order by severity desc, seq, technique limit 12) h left join ({_EVIDENCE}) e using (technique)""", _SEMANTICS + _PRE + _FINDINGS + _DEDUP + _SHOWN)
def hypotheses_rank(spark, sf_dir):
    rows = events(spark, sf_dir)
    scored = heuristics.with_replication(heuristics.event_semantics(rows))
    return heuristics.with_evidence(heuristics.hypotheses(scored, dedup_findings(spark, sf_dir)), rows)


@query("select seq, technique, host from nw", _SEMANTICS + _FINDINGS + _DEDUP + _SHOWN)
def hyp_drop_confirmed(spark, sf_dir):
    scored = heuristics.event_semantics(events(spark, sf_dir)).where("severity >= 5")
    shown = scored.select("seq", F.col("hostname").alias("host"), F.explode("techniques").alias("technique"))
    confirmed = dedup_findings(spark, sf_dir).select(F.col("mitre").alias("technique"), F.col("hostname").alias("host")).distinct()
    return heuristics.drop_confirmed(shown, confirmed).select("seq", "technique", "host")


@query("select seq as id from ev where seq % 11 <> 0 and (seq % 13 <> 0)")
def hyp_grounding(spark, sf_dir):
    rows = events(spark, sf_dir)
    named = rows.selectExpr("seq as id", "array(if(seq % 11 = 0, 'nowhere', upper(hostname))) as hosts", "if(seq % 13 = 0, array(user_name, 'nobody'), array(user_name)) as users")
    return heuristics.grounded(named, rows).select("id")


@query("select seq, mitre, coalesce(name, 'Unknown') as technique_name, coalesce(tac, 'Unknown') as technique_tactic, 'https://attack.mitre.org/techniques/' || replace(mitre, '.', '/') || case when name is null then '' else '/' end as technique_url from de left join (values "
       + ", ".join(f"('{t}', {_lit(n)}, '{c}')" for t, n, c in severity.TECHNIQUES) + ") m(id, name, tac) on id = mitre", _FINDINGS + _DEDUP)
def mitre_lookup(spark, sf_dir):
    return severity.mitre_lookup(dedup_findings(spark, sf_dir)).select("seq", "mitre", "technique_name", "technique_tactic", "technique_url")


@query(f"select {_TACTIC.replace('(t,', '(mitre,')} as phase, count(*) as findings, count(distinct mitre) as techniques from de group by 1", _FINDINGS + _DEDUP)
def tactic_rollup(spark, sf_dir):
    return dedup_findings(spark, sf_dir).groupBy(severity.tactic_of(F.col("mitre")).alias("phase")).agg(F.count("*").alias("findings"), F.countDistinct("mitre").alias("techniques"))


@query(f"""select severity, number, {_RANK} as severity_rank, 'P' || cast(least(3, 4 - {_RANK}) as varchar) as priority, {_NUMBER} as severity_number, case when number >= 9 then 'critical' when number >= 7 then 'high' when number >= 5 then 'medium' else 'clean' end as word,
 case when number >= 9 then 0.9::double when number >= 7 then 0.75::double when number >= 5 then 0.55::double else 0.4::double end as confidence, case when number >= 9 then 'High' when number >= 7 then 'Elevated' when number >= 5 then 'Moderate' else 'Low' end as band, n
 from (select severity, cast(seq % 10 + 1 as int) as number, count(*) as n from fi group by 1, 2) x""", _FINDINGS)
def severity_map(spark, sf_dir):
    return severity.severity_map(rules_evaluate(spark, sf_dir).groupBy("severity", F.expr("cast(seq % 10 + 1 as int)").alias("number")).agg(F.count("*").alias("n")))


@query("select i as rule_ord, id as rule_id, name as rule_name, sev as severity, count(fi.seq) as findings from (values " + ", ".join(f"({i}, '{r.id}', {_lit(r.name)}, '{r.severity}')" for i, r in enumerate(rules.RULES)) + ") r(i, id, name, sev) left join fi on fi.rule_id = id group by 1, 2, 3, 4", _FINDINGS)
def rules_summary(spark, sf_dir):
    found = rules_evaluate(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("findings"))
    return rules.summary(spark).join(found, "rule_id", "left").select("rule_ord", "rule_id", "rule_name", "severity", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("""select 'address' as kind, value, 1 as ord from (select distinct destination_ip as value from ev where destination_ip <> '' order by 1 limit 5) a
 union all select 'process', process_name || ' (' || rule_name || ')', cast(n as int) from (select process_name, arg_min(rule_name, n) as rule_name, min(n) as n from (select process_name, rule_name, row_number() over (order by seq, rule_ord) as n from (select * from de order by seq, rule_ord limit 10) d0) d where process_name <> '' group by 1) b""", _FINDINGS + _DEDUP)
def suggest_pivots(spark, sf_dir):
    return summaries.pivots(events(spark, sf_dir), dedup_findings(spark, sf_dir))


_UNION = "select seq, array_to_string(list_sort(list_distinct(list_concat(techs, [t for t in [mitre] if t is not null]))), '|') as techniques from sem left join (select seq as q, arg_min(mitre, rule_ord) as mitre from fi group by 1) r on r.q = sem.seq"


@query(_UNION, _SEMANTICS + _FINDINGS)
def techniques_union(spark, sf_dir):
    rows = events(spark, sf_dir)
    first = rules.evaluate(rows).groupBy("seq").agg(F.min_by("mitre", "rule_ord").alias("mitre"))
    joined = heuristics.event_semantics(rows).join(first, "seq", "left")
    both = F.array_union("techniques", F.array_compact(F.array("mitre")))
    return joined.select("seq", F.array_join(F.array_sort(both), "|").alias("techniques"))


#: Questions in words: several keywords, an order with the same host, an order with the same user, no known word.
_QUESTIONS = {
    "dump": "Any LSASS access or credential dump?",
    "then": "After an encoded command or a download, what ran on the same host?",
    "next": "mimikatz, and what did that account do next?",
    "any": "show me everything",
}
_ASKED = """, qa as (select 'dump' as question, * from ev where contains(lower(commandline), 'lsass')
 union all select 'then', * from ev where regexp_matches(commandline, '(?i)-e(nc)?\\b') or regexp_matches(commandline, '(?i)(downloadstring|downloadfile|invoke-webrequest|iwr|net\\.webclient)')
 union all select 'next', * from ev where contains(lower(commandline), 'mimikatz'))"""


@query("""select 'dump' as question, seq, hostname from qa where question = 'dump' union all select 'any', seq, hostname from ev where process_name <> ''
 union all select 'then', seq, hostname from ev where process_name <> '' and ts > (select min(ts) from qa where question = 'then') and hostname in (select hostname from qa where question = 'then' and hostname <> '')
 union all select 'next', seq, hostname from ev where process_name <> '' and ts > (select min(ts) from qa where question = 'next') and user_name in (select user_name from qa where question = 'next' and user_name <> '')""", _ASKED)
def hunt_keywords(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = [hunt.run_hunt(rows, hunt.asked(text)).select(F.lit(name).alias("question"), "seq", "hostname") for name, text in _QUESTIONS.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("select 'a' as step, count(*) filter (event_outcome = 'success') as events from ev union all select 'b', count(*) filter (contains(lower(commandline), 'minidump')) from ev")
def hunt_step_counts(spark, sf_dir):
    """Events that match each step of the hunt above, counted while the steps are found."""
    relations = [{"type": "same", "step": "a", "field": "hostname"}]
    counts = hunt.execute(events(spark, sf_dir), {"steps": [_A, _B], "relations": relations, "select": "b"})[1]
    return spark.createDataFrame(list(counts.items()), "step string, events long")


#: Raw records with source names, made from the events: dashes, second names, paths, padded and odd ids, missing commands.
_RAW = {
    "HostName": "case when seq % 3 = 0 then '-' else hostname end", "Computer": "case when seq % 3 = 0 then hostname end", "User": "user_name",
    "EventID": "case when seq % 4 = 0 then 'x' || event_id else '00' || event_id end", "Image": "process_path", "ProcessName": "case when seq % 5 = 0 then '12.5e1' end",
    "CommandLine": "case when seq % 7 > 0 then commandline end", "message": "'said ' || cast(seq as varchar(20))", "ProcessGuid": "case when seq % 6 > 0 then process_guid end",
}


@query("""select seq, hostname, nullif(user_name, '') as user_name, case when seq % 4 = 0 then 'x' || event_id else event_id end as event_id, case when seq % 5 = 0 then regexp_extract(process_path, '([^\\\\/]*)$', 1) else regexp_extract(process_path, '([^\\\\/]*)$', 1) end as process_name,
    process_path, case when seq % 7 > 0 then commandline else 'said ' || cast(seq as varchar) end as commandline, seq % 6 > 0 as given from ev""")
def norm_alias_coalesce(spark, sf_dir):
    pairs = [x for name, sql in _RAW.items() for x in (F.lit(name), F.expr(sql))]
    raw = events(spark, sf_dir).select(F.lit("f").alias("_src"), "seq", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("raw"))
    return canonical(raw).select("seq", "hostname", "user_name", "event_id", "process_name", "process_path", "commandline", F.col("process_guid").startswith("p-").alias("given"))


@query("select seq, cast(floor(epoch(ts)) as bigint) as seconds from ev")
def norm_timestamp(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    forms = [F.unix_seconds(at).cast("string"), F.unix_millis(at).cast("string"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "MMM d, yyyy '@' HH:mm:ss.SSS"), F.date_format(at, "yyyy/MM/dd HH:mm:ss"), F.date_format(at, "dd/MMM/yyyy:HH:mm:ss '+0000'")]
    text = F.coalesce(*(F.when(F.col("seq") % len(forms) == i, f) for i, f in enumerate(forms)))
    return events(spark, sf_dir).select("seq", F.unix_seconds(timestamp(text)).alias("seconds"))


#: The parts of an analysis and the queries that give the same rows.
_PARTS = {
    "findings": "dedup_findings", "correlated": "corr_bruteforce", "severity_counts": "agg_severity_counts", "incidents": "incidents_build", "nodes": "agg_graph_nodes", "edges": "graph_edges",
    "facets": "agg_facets", "timeline": "enrich_timeline", "prescan": "agg_prescan", "hypotheses": "hypotheses_rank", "summary": "agg_session_summary",
}


@query()
def analyze_session(spark, sf_dir):
    """The sizes of all results of one analysis."""
    found = session.analyze(events(spark, sf_dir))
    sizes = [rows.agg(F.lit(part).alias("part"), F.count("*").alias("n")) for part, rows in found.items()]
    return reduce(DataFrame.union, sizes)


_ORACLES["analyze_session"] = " union all ".join(f"select '{part}' as part, count(*) as n from ({_ORACLES[name]}) {part}" for part, name in _PARTS.items())


#: Verdicts that a model might have given, as JSON, made from the events.
_SAID = "'{\"severity\": ' || cast(seq % 13 as varchar(9)) || ', \"is_malicious\": ' || case when seq % 2 = 0 then 'true' else 'false' end || ', \"mitre_techniques\": [\"T1027\", \"bad\"], \"indicators\": [\"said\"]' || case when seq % 17 = 0 then '' else '}' end"


def _verdicts(spark, sf_dir):
    rows = events(spark, sf_dir)
    return verdicts.validate(rows.select("seq", F.expr(_SAID).alias("json"))), rows


_VALID = ", vd as (select seq, seq % 17 <> 0 as valid, case when seq % 17 = 0 then 1 else least(greatest(seq % 13, 1), 10) end as severity, seq % 17 <> 0 and seq % 2 = 0 as is_malicious, case when seq % 17 = 0 then [] else ['T1027'] end as techniques, case when seq % 17 = 0 then [] else ['said'] end as indicators from ev)"


#: Verdicts of every odd kind: numbers as texts, fractions, words, null, lists; texts for lists; broken JSON.
_SAID_ODD = """'{"severity": ' || case when seq % 19 = 0 then '"high"' when seq % 5 = 0 then '" ' || cast(seq % 13 as varchar(9)) || '"' when seq % 23 = 0 then cast(seq % 13 as varchar(9)) || '.7'
 when seq % 29 = 0 then 'null' when seq % 31 = 0 then '[1]' when seq % 37 = 0 then 'true' else cast(seq % 13 - 2 as varchar(9)) end
 || ', "is_malicious": ' || case seq % 4 when 0 then 'true' when 1 then 'false' when 2 then '"true"' else '1' end
 || ', "mitre_techniques": ' || case when seq % 3 > 0 then '["T1027", "bad", 7, "T1059.001"]' else '"T1027"' end
 || ', "indicators": ' || case when seq % 6 = 0 then '["a", null, 3, true, {"k":1}]' else '[]' end
 || case when seq % 7 > 0 then ', "intent": "of ' || hostname || '", "decoded": 5' else ', "intent": null, "more": {}' end || case when seq % 17 = 0 then '' else '}' end"""
_VALID_ODD = """, od as (select *, case when seq % 19 = 0 then null when seq % 5 = 0 then seq % 13 when seq % 23 = 0 then seq % 13 when seq % 29 = 0 then null when seq % 31 = 0 then null when seq % 37 = 0 then 1 else seq % 13 - 2 end as num from ev),
 ov as (select *, seq % 17 <> 0 and num is not null as ok from od)"""


@query("""select seq, ok as valid, cast(case when ok then least(greatest(num, 1), 10) else 1 end as int) as severity, ok and seq % 4 = 0 as is_malicious, case when ok and seq % 3 > 0 then 'T1027|T1059.001' else '' end as techniques,
 case when ok and seq % 6 = 0 then 'a||3|True|{"k":1}' else '' end as indicators, case when not ok then 'The model returned an invalid response.' when seq % 7 > 0 then 'of ' || hostname else '' end as intent,
 case when ok and seq % 7 > 0 then '5' end as said_decoded, case when ok then 'llm' else 'llm-invalid' end as source,
 cast(case when seq % 17 = 0 then 1 else case when seq % 3 > 0 then 2 else 1 end + case when seq % 19 = 0 or (seq % 5 > 0 and seq % 23 > 0 and seq % 29 > 0 and seq % 31 = 0) then 1 else 0 end end as int) as errors from ov""", _VALID_ODD)
def verdict_validate(spark, sf_dir):
    found = verdicts.validate(events(spark, sf_dir).select("seq", F.expr(_SAID_ODD).alias("json")))
    return found.select("seq", "valid", "severity", "is_malicious", _joined("techniques", True), _joined("indicators", True), "intent", "said_decoded", "source", F.size("errors").alias("errors"))


#: Reports on sessions of every odd kind.
_REPORT = """'{"x": 1' || case seq % 5 when 0 then ', "overall_severity": "HIGH"' when 1 then ', "overall_severity": "low"' when 2 then ', "overall_severity": "odd"' when 3 then ', "overall_severity": 3' else '' end
 || case seq % 3 when 0 then ', "attack_stage": "Execution"' when 1 then ', "attack_stage": "execution"' else '' end || ', "affected_hosts": ["' || hostname || '", null, 5]'
 || case when seq % 4 > 0 then ', "techniques_used": [{"id": "T1003", "name": "n"}, {"id": "bad"}, 5, {"name": "x"}, {"id": "T1059.001", "description": 7}]' else ', "techniques_used": {}' end
 || case seq % 6 when 0 then ', "threat_actor_profile": null' when 1 then ', "threat_actor_profile": "P"' else '' end || case when seq % 17 = 0 then '' else '}' end"""


@query("""select seq, ok as valid, case when ok and seq % 5 = 0 then 'high' when ok and seq % 5 = 1 then 'low' else 'clean' end as overall_severity, case when ok and seq % 3 = 0 then 'Execution' else 'Unknown' end as attack_stage,
 case when ok then hostname || '||5' else '' end as affected_hosts, case when ok and seq % 4 > 0 then 'T1003:n:|T1059.001::7' else '' end as techniques_used,
 case when ok and seq % 6 = 0 then '' when ok and seq % 6 = 1 then 'P' else 'Unknown' end as threat_actor_profile from (select *, seq % 17 <> 0 as ok from ev) x""")
def verdict_session(spark, sf_dir):
    found = verdicts.validate_session(events(spark, sf_dir).select("seq", F.expr(_REPORT).alias("json")))
    used = F.array_join(F.transform("techniques_used", lambda t: F.concat_ws(":", t["id"], t["name"], t["description"])), "|").alias("techniques_used")
    return found.select("seq", "valid", "overall_severity", "attack_stage", _joined("affected_hosts", True), used, "threat_actor_profile")


_FLOOR = ", fl as (select vd.seq, cast(greatest(vd.severity, sev) as int) as severity, case when sev > vd.severity then sev >= 5 else is_malicious end as is_malicious, list_sort(list_distinct(list_concat(techniques, techs))) as techniques, len(list_distinct(list_concat(indicators, inds))) as n, sev, sev >= 5 as hm from vd join sem on sem.seq = vd.seq)"


def _floored(spark, sf_dir):
    said, rows = _verdicts(spark, sf_dir)
    scored = heuristics.event_semantics(rows)
    return verdicts.floor(said, scored, "seq").join(scored.select("seq", F.col("severity").alias("heuristic")), "seq")


@query("select seq, severity, is_malicious, array_to_string(techniques, '|') as techniques from fl", _SEMANTICS + _VALID + _FLOOR)
def verdict_floor(spark, sf_dir):
    return _floored(spark, sf_dir).select("seq", "severity", "is_malicious", _joined("techniques"))


@query("""select seq, round(case when agree then v else least(v, 0.45) end, 2)::double as confidence, not agree or not (strong or benign) as abstained from (select *, is_malicious = hm as agree, severity >= 7 or sev >= 7 as strong, severity <= 2 and n = 0 as benign,
 case when severity >= 7 or sev >= 7 then least(0.95, 0.7 + 0.05 * n) when severity <= 2 and n = 0 then 0.7 else 0.4 end as v from fl) x""", _SEMANTICS + _VALID + _FLOOR)
def verdict_confidence(spark, sf_dir):
    agree = F.col("is_malicious") == (F.col("heuristic") >= 5)
    return heuristics.confidence(_floored(spark, sf_dir), F.col("heuristic"), agree).select("seq", "confidence", "abstained")


_NUDGED = """, nd as (select sc.*, coalesce(severity < 7 and label, false) as up, coalesce(severity < 7 and not label, false) as down, similarity, corrected from sc left join (
 select fs.commandline as c, fs.label, fs.similarity, fb.corrected_severity as corrected from fs join good using (id) join fb on fb.seq = good.seq where fs.rank = 1 and similarity >= 0.8) e on c = commandline)"""


@query(f"""select commandline, {_CONTEXT}, case when up then greatest(7, coalesce(corrected, 7)) when down then least(severity, 2) else severity end as severity, up or (is_malicious and not down) as is_malicious, up or down as moved,
 case when up or down then round(greatest(0.8, least(similarity, 0.97)), 2) else confidence end as confidence, abstained and not (up or down) as abstained, case when up or down then source || '+fewshot' else source end as source,
 array_to_string(list_concat(inds, case when up then ['Analyst-labelled a near-identical command as malicious ' || printf('(sim=%.2f)', similarity)] when down then ['Analyst-cleared a near-identical command as benign ' || printf('(sim=%.2f)', similarity)] else [] end), '|') as indicators
 from nd""", _FINDINGS + _COMMANDS + _FEEDBACK + _FEWSHOT + _NUDGED)
def verdict_feedback_nudge(spark, sf_dir):
    moved = verdicts.nudge(_commands(spark, sf_dir), _fewshot(spark, sf_dir), "commandline")
    return moved.select("commandline", *heuristics.CONTEXT, "severity", "is_malicious", "moved", "confidence", "abstained", "source", _joined("indicators", True))


@query("select case when seq % 2 = 0 then analyst else '' end as analyst, commandline, label, case when corrected_severity is null then -1 else corrected_severity end as corrected_severity from fb", _FEEDBACK)
def sink_feedback_jsonl(spark, sf_dir):
    """The rows of the export, with every second analyst left out, as they come back from JSON lines."""
    from .operators.shared import Scratch

    path = f"{Scratch(spark, 'export').base}/jsonl"
    rows = _feedback(spark, sf_dir).select("commandline", "label", "corrected_severity", F.expr("if(seq % 2 = 0, analyst, '')").alias("analyst"))
    verdicts.export_feedback(rows, path)
    back = spark.read.schema("commandline string, label boolean, corrected_severity int, analyst string").json(path)
    return back.select("analyst", "commandline", "label", F.coalesce("corrected_severity", F.lit(-1)).alias("corrected_severity"))


@query("select cast(cast(ts as date) as varchar) as day, severity, count(*) as n from de group by 1, 2", _FINDINGS + _DEDUP)
def sink_findings(spark, sf_dir):
    """Findings written by day and severity, all of them, then those of HIGH again, read back and counted."""
    from .operators.shared import Scratch

    path, found = f"{Scratch(spark, 'sink').base}/findings", dedup_findings(spark, sf_dir)
    verdicts.write_findings(found, path)
    verdicts.write_findings(found.where("severity = 'HIGH'"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "severity").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
