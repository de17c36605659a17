"""Every rule fires on its hit and not on its near miss; playbooks; correlation by name."""

import json
from datetime import datetime, timedelta

import pytest

from threatlake.operators import rules

#: rule -> fields of a hit, fields of a near miss
CASES = {
    "TH-001": ({"process_name": "PowerShell.exe", "commandline": "x -EncodedCommand y"}, {"process_name": "powershell.exe", "commandline": "x -encrypt y"}),
    "TH-002": ({"process_name": "pwsh.exe", "commandline": "irm http://x"}, {"process_name": "cmd.exe", "commandline": "irm x"}),
    "TH-003": ({"process_name": "powershell.exe", "commandline": "-ep bypass"}, {"process_name": "powershell.exe", "commandline": "-ep normal"}),
    "TH-004": ({"process_name": "mshta.exe", "commandline": "mshta vbscript:x"}, {"process_name": "mshta.exe", "commandline": "mshta file.hta"}),
    "TH-005": ({"process_name": "rundll32.exe", "commandline": "rundll32 url.dll,x"}, {"process_name": "rundll32.exe", "commandline": "rundll32 urlxdll"}),
    "TH-006": ({"process_name": "regsvr32.exe", "commandline": "regsvr32 /S x"}, {"process_name": "regsvr32.exe", "commandline": "regsvr32 x.dll"}),
    "TH-007": ({"process_name": "certutil.exe", "commandline": "certutil -decode a b"}, {"process_name": "certutil.exe", "commandline": "certutil -dump a"}),
    "TH-008": ({"process_name": "bitsadmin.exe", "commandline": "bitsadmin /addfile x"}, {"process_name": "bitsadmin.exe", "commandline": "bitsadmin /list"}),
    "TH-009": ({"process_name": "procdump64.exe", "commandline": "procdump64 -ma LSASS"}, {"process_name": "procdump64.exe", "commandline": "procdump64 -ma calc"}),
    "TH-025": ({"event_id": "10", "target_image": "C:\\\\lsass.exe", "granted_access": "0x10"}, {"event_id": "10", "target_image": "C:\\\\lsass.exe", "granted_access": "0x1000"}),
    "TH-010": ({"commandline": "privilege::debug"}, {"commandline": "privilege debug"}),
    "TH-011": ({"event_id": "4662", "object_guid": "{1131F6AD-9c07-11d1-f79f-00c04fc2dcd2}"}, {"event_id": "4661", "properties": "DS-Replication-Get-Changes"}),
    "TH-012": ({"process_name": "PSEXESVC.exe"}, {"process_name": "psexec"}),
    "TH-013": ({"process_name": "wmic.exe", "commandline": "wmic process where x call a create"}, {"process_name": "wmic.exe", "commandline": "wmic process list"}),
    "TH-014": ({"process_name": "sc.exe", "commandline": "sc \\\\host create x"}, {"process_name": "sc.exe", "commandline": "sc create x"}),
    "TH-015": ({"process_name": "schtasks.exe", "commandline": "schtasks /Change x"}, {"process_name": "schtasks.exe", "commandline": "schtasks /query"}),
    "TH-016": ({"process_name": "reg.exe", "commandline": "reg add HKLM\\Run"}, {"process_name": "reg.exe", "commandline": "reg query HKLM\\Run"}),
    "TH-017": ({"event_id": "7045"}, {"event_id": "7046"}),
    "TH-018": ({"process_name": "net.exe", "commandline": "net group x"}, {"process_name": "net.exe", "commandline": "net time"}),
    "TH-019": ({"process_name": "whoami.exe"}, {"process_name": "whoami"}),
    "TH-020": ({"commandline": "curl 1.1.1.1/dns-query"}, {"commandline": "curl 1.1.1.1"}),
    "TH-021": ({"event_id": "18", "commandline": "Pipe x"}, {"event_id": "16", "commandline": "pipe x"}),
    "TH-022": ({"process_name": "net.exe", "parent_process_name": "SMSS.exe"}, {"process_name": "net.exe", "parent_process_name": "services.exe"}),
    "TH-023": ({"process_path": "", "process_name": "C:\\Temp\\a.exe"}, {"process_path": "C:\\Tempo\\a.exe", "process_name": "a"}),
    "TH-024": ({"event_id": "8", "commandline": "writeprocessmemory"}, {"event_id": "1", "commandline": "writeprocessmemory"}),
}
FIELDS = ["process_name", "commandline", "event_id", "target_image", "granted_access", "object_guid", "properties", "access_mask", "parent_process_name", "process_path", "event_outcome", "action_type", "event_category", "hostname", "user_name", "process_guid", "source_ip"]


def frame(spark, rows):
    schema = "seq long, ts timestamp, " + ", ".join(f"{f} string" for f in FIELDS)
    return spark.createDataFrame([(k, r.get("ts"), *(r.get(f) for f in FIELDS)) for k, r in enumerate(rows)], schema)


def test_hits_and_near_misses(spark):
    assert set(CASES) == {r.id for r in rules.RULES} and len(CASES) == 25
    rows = [r for pair in CASES.values() for r in pair]
    fired = {}
    for r in rules.evaluate(frame(spark, rows)).collect():
        fired.setdefault(r.seq, set()).add(r.rule_id)
    for k, rule in enumerate(CASES):
        assert rule in fired.get(2 * k, set()), rule
        assert rule not in fired.get(2 * k + 1, set()), rule


def test_playbooks(spark, tmp_path):
    book = {"rules": [
        {"id": "A", "name": "a", "severity": "HIGH", "match": {"process_name": "X.exe", "event_outcome": ["Failed", "denied"]}},
        {"id": "B", "name": "b", "match": {"action_type": "logged-in", "event_category": ["authentication"], "event_id": [4624]}},
        {"id": "C", "name": "c", "match": {"parent_child_anomaly": True, "suspicious_parents": {"a.exe": ["b.exe"]}, "event_id": 1}}, {"id": "D", "name": "d"},
    ]}
    rows = frame(spark, [
        {"process_name": "x.EXE", "event_outcome": "DENIED"}, {"process_name": "x.exe", "event_outcome": "ok"}, {"action_type": "Logged-In", "event_category": "Authentication", "event_id": "4624"},
        {"process_name": "a.exe", "parent_process_name": "B.exe", "event_id": "1"}, {"process_name": "a.exe", "parent_process_name": "b.exe", "event_id": "2"},
    ])
    (tmp_path / "book.json").write_text(json.dumps(book))
    (tmp_path / "book.yaml").write_text(json.dumps(book))  # JSON is YAML
    for name in ("book.json", "book.yaml"):
        loaded = rules.load_playbook(spark, str(tmp_path / name))
        assert sorted((r.seq, r.rule_id, r.severity) for r in rules.evaluate(rows, loaded).collect()) == [(0, "A", "HIGH"), (2, "B", "LOW"), (3, "C", "LOW")]
    book["rules"][0]["match"]["commandline_regex"] = "("
    (tmp_path / "bad.json").write_text(json.dumps(book))
    with pytest.raises(ValueError, match="rule A"):
        rules.load_playbook(spark, str(tmp_path / "bad.json"))


def test_names_of_users_who_do_not_exist(spark):
    start = datetime(2024, 1, 1)
    made = lambda ip, users, outcome="failed": [{"process_name": "SSHD", "source_ip": ip, "user_name": u, "event_outcome": outcome, "hostname": "h", "ts": start + timedelta(minutes=k)} for k, u in enumerate(users)]
    six = ["(invalid user)", "(Unknown User)", "(unknown)", " invalid user ", "unknown user", "UNKNOWN"]
    rows = made("1.1.1.1", six) + made("2.2.2.2", ["", None, "", "", "", "", ""]) + made("3.3.3.3", [*six, "root", ""]) + made("4.4.4.4", six[:5]) + made("4.4.4.4", ["ann", ""], "Success")
    got = {(r.source_ip, r.rule_id): (r.invalid_failures, r.accounts) for r in rules.bruteforce(frame(spark, rows)).collect()}
    assert got == {("1.1.1.1", "TH-CORR-003"): (6, ""), ("3.3.3.3", "TH-CORR-002"): (6, "root"), ("4.4.4.4", "TH-CORR-001"): (5, "ann")}
