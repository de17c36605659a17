"""Severity words, ranks, numbers, priorities; techniques and tactics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank of a severity word of any case; what is not one counts as benign.
RANK = "case upper(severity) when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"
#: Number of a severity word.
NUMBER = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 5, "LOW": 3}
#: Technique, name, tactic.
TECHNIQUES = (
    ("T1059.001", "PowerShell", "Execution"),
    ("T1562.001", "Disable or Modify Tools", "Defense Evasion"),
    ("T1218.005", "Mshta", "Defense Evasion"),
    ("T1218.011", "Rundll32", "Defense Evasion"),
    ("T1218.010", "Regsvr32", "Defense Evasion"),
    ("T1140", "Deobfuscate/Decode Files", "Defense Evasion"),
    ("T1197", "BITS Jobs", "Defense Evasion"),
    ("T1003.001", "LSASS Memory", "Credential Access"),
    ("T1003.006", "DCSync", "Credential Access"),
    ("T1021.002", "SMB/Windows Admin Shares", "Lateral Movement"),
    ("T1047", "WMI", "Execution"),
    ("T1543.003", "Windows Service", "Persistence"),
    ("T1053.005", "Scheduled Task", "Persistence"),
    ("T1547.001", "Registry Run Keys", "Persistence"),
    ("T1018", "Remote System Discovery", "Discovery"),
    ("T1082", "System Information Discovery", "Discovery"),
    ("T1071.004", "DNS", "Command and Control"),
    ("T1134.001", "Token Impersonation", "Privilege Escalation"),
    ("T1055", "Process Injection", "Defense Evasion"),
    ("T1055.012", "Process Hollowing", "Defense Evasion"),
    ("T1204.002", "Malicious File", "Execution"),
    ("T1218", "System Binary Proxy Execution", "Defense Evasion"),
)
#: Parent technique -> tactic.
TACTICS = {
    "T1003": "Credential Access", "T1027": "Defense Evasion", "T1047": "Execution", "T1053": "Persistence", "T1059": "Execution", "T1110": "Credential Access",
    "T1140": "Defense Evasion", "T1197": "Defense Evasion", "T1218": "Defense Evasion", "T1543": "Persistence", "T1547": "Persistence", "T1562": "Defense Evasion",
    "T1021": "Lateral Movement",
}


def priority(rank: Column) -> Column:
    """P0 for critical to P3 for low and below."""
    return F.concat(F.lit("P"), F.least(F.lit(3), F.greatest(F.lit(0), 4 - rank)).cast("string"))


def word_of_number(number: Column) -> Column:
    return F.when(number >= 9, "critical").when(number >= 7, "high").when(number >= 5, "medium").otherwise("clean")


def number_of_word(word: Column) -> Column:
    """The number of a severity word; an unknown one counts as low."""
    return F.coalesce(*(F.when(F.upper(word) == w, n) for w, n in NUMBER.items()), F.lit(NUMBER["LOW"]))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "High").when(confidence >= 0.6, "Elevated").when(confidence >= 0.45, "Moderate").otherwise("Low")


def confidence_of_number(number: Column) -> Column:
    return F.when(number >= 9, 0.9).when(number >= 7, 0.75).when(number >= 5, 0.55).otherwise(0.4)


def severity_map(rows: DataFrame) -> DataFrame:
    """Adds what follows from the columns severity (a word) and number: rank, priority, numbers, words, confidence."""
    rank = F.expr(RANK)
    return rows.withColumns({
        "severity_rank": rank, "priority": priority(rank), "severity_number": number_of_word(F.col("severity")), "word": word_of_number(F.col("number")),
        "confidence": confidence_of_number(F.col("number")), "band": band(confidence_of_number(F.col("number"))),
    })


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TECHNIQUES), "technique string, technique_name string, technique_tactic string")


def mitre_lookup(rows: DataFrame, column: str = "mitre") -> DataFrame:
    """Adds name, tactic and address of a technique; the table of 22 rows is broadcast."""
    known = F.broadcast(techniques(rows.sparkSession))
    url = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(F.col(column), F.lit("."), F.lit("/")))
    out = rows.join(known, rows[column] == known["technique"], "left").drop("technique")
    known_name = F.col("technique_name").isNotNull()
    return out.withColumns({
        "technique_url": F.when(known_name, F.concat(url, F.lit("/"))).otherwise(url), "technique_name": F.coalesce("technique_name", F.lit("Unknown")),
        "technique_tactic": F.coalesce("technique_tactic", F.lit("Unknown")),
    })


def tactic_of(technique: Column) -> Column:
    """The tactic of a technique or its parent, null if there is none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in TACTICS.items() for x in pair)), F.substring_index(technique, ".", 1))
