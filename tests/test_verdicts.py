import base64
import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from threatlake.functions.normalize import uuid5
from threatlake.operators import verdicts


def test_uuid5_equals_python(spark):
    names = ["host-a.exe-2024-01-01-run", "", "héte", "x" * 500]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(uuid5(F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_rights_come_from_command_properties_and_object(spark):
    guid = "89E95B76-444d-4c62-991a-0facbeda640c"
    rows = [(1, "h", "u", "1", f"tool {guid}", None, None), (2, "h", "u", "4662", "x", "Replication of all", None),
            (3, "h", "u", "4662", "x", None, guid), (4, "h", "u", "1", "x", "replication", guid), (5, None, None, None, None, None, None)]
    events = spark.createDataFrame(rows, "seq long, hostname string, user_name string, event_id string, commandline string, properties string, object_guid string")
    got = {r.seq: r.matched_right for r in verdicts.replication_rights(events).collect()}
    assert got == {1: "DS-Replication-Get-Changes-In-Filtered-Set", 2: "Replication of all", 3: "DS-Replication-Get-Changes-In-Filtered-Set"}


def test_excluding_every_finding_keeps_the_severity(spark):
    found = spark.createDataFrame([("a", 1, "r", "HIGH"), ("a", 2, "r", "LOW"), ("b", 3, "r", "CRITICAL")], "incident string, seq long, rule_id string, severity string")
    got = {r.incident: r for r in verdicts.exclude_findings(found, found.where("seq <> 2")).collect()}
    assert (got["a"].severity_rank, got["a"].priority, got["a"].active_finding_count, got["a"].all_excluded) == (1, "P3", 1, False)
    assert (got["b"].severity_rank, got["b"].priority, got["b"].active_finding_count, got["b"].all_excluded) == (4, "P0", 0, True)


def test_summary_of_no_findings_is_clean(spark):
    none = spark.createDataFrame([], "severity string, tactic string, hostname string, user_name string, mitre string, rule_id string, rule_name string, seq long, rule_ord int")
    got = {r["item"]: r["value"] for r in verdicts.session_summary(none).collect()}
    assert got == {"overall_severity": "clean", "attack_stage": "None", "findings": "0", "critical": "0"}


def test_export_leaves_identities_out(spark, tmp_path):
    rows = spark.createDataFrame([("cmd", True, "ann", 0.5)], "commandline string, agree boolean, analyst string, trust double")
    verdicts.export_feedback(rows, str(tmp_path / "out"), deidentify=True)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"commandline": "cmd", "agree": True}]


def test_labels_move_only_what_is_open(spark):
    rows = [("a", 9, True), ("b", 5, True), ("c", 5, True), ("d", 1, False), ("e", 6, True), ("f", 3, False)]
    scored = spark.createDataFrame([(c, s, m, 0.4) for c, s, m in rows], "commandline string, severity int, is_malicious boolean, confidence double")
    near = [("a", False, None, 0.99), ("b", False, None, 0.9), ("b", True, 10, 0.85), ("c", True, 9, 0.81), ("d", True, None, 1.0), ("e", False, 1, 0.79)]
    examples = spark.createDataFrame(near, "commandline string, label boolean, corrected_severity int, similarity double")
    got = {r.commandline: (r.severity, r.is_malicious, r.moved, r.confidence) for r in verdicts.nudge(scored, examples, "commandline").collect()}
    assert got == {"a": (9, True, False, 0.4), "b": (2, False, True, 0.9), "c": (9, True, True, 0.81), "d": (7, True, True, 0.97), "e": (6, True, False, 0.4), "f": (3, False, False, 0.4)}


def test_verdicts_in_json(spark):
    cases = {
        '{"severity": 14, "is_malicious": true, "mitre_techniques": ["T1003", "T1003.001", "T1", 7]}': (True, 10, True, ["T1003", "T1003.001"]),
        '{"severity": "3", "is_malicious": "yes"}': (True, 3, False, []), '{"severity": "high"}': (False, 1, False, []), '{"severity": -4}': (True, 1, False, []),
        "[1]": (False, 1, False, []), "not json": (False, 1, False, []), "": (False, 1, False, []), None: (False, 1, False, []),
    }
    got = {r.json: (r.valid, r.severity, r.is_malicious, r.techniques) for r in verdicts.validate(spark.createDataFrame([(c,) for c in cases], "json string")).collect()}
    assert got == cases


def test_known_bad_commands(spark):
    """Commands of the fixed lists are nearest to themselves; scores against a plain cosine."""
    from threatlake.operators import summaries, vectors

    texts = [vectors.KNOWN_BAD[3][0], vectors.BENIGN[0], "zzzzqqqq"]
    embed = lambda rows: summaries.embed(rows, "text")
    near, per = vectors.known_bad(embed(spark.createDataFrame([(t,) for t in texts], "text string")), embed, 3)
    best = {r.text: (r.corpus_id, round(r.score, 6)) for r in near.where("rank = 1").collect()}
    assert best[texts[0]] == (3, 1.0) and near.count() == 9
    rows = {r.text: r for r in per.collect()}
    assert rows[texts[0]].like_bad and rows[texts[0]].family == "credential-access" and abs(rows[texts[1]].benign_score - 1) < 1e-6
    assert not rows["zzzzqqqq"].like_bad and rows["zzzzqqqq"].family is None


def test_forms_of_untrusted_json(spark):
    """Each kind of field: bounds, enums, patterns, lists, nested objects, required fields, defaults."""
    from threatlake.functions.schema import Field, against

    form = (
        Field("s", default="", longest=5), Field("i", "int", 1, 1, 10), Field("f", "float", 0.0, 0.0, 1.0), Field("b", "bool", False), Field("e", "enum", "a", values=("a", "b")),
        Field("l", "list", (), longest=4, most=3, pattern="[a-z]+"), Field("d", "dict", {}, fields=(Field("x", "int", 0),)),
        Field("ds", "dicts", (), most=3, fields=(Field("id"), Field("n", "int", 0)), drop=True), Field("req"),
    )
    none = {"s": "", "i": 1, "f": 0.0, "b": False, "e": "a", "l": [], "d": {"x": 0}, "ds": [], "req": None}
    cases = {
        '{"s":"abcdefgh","i":"12","f":2,"b":true,"e":"b","l":["ab","AB","cdefgh","x"],"d":{"x":"7","y":1},"ds":[{"id":"q"},{"n":1},5,{"id":"z"}],"req":true}': (
            {"s": "abcde", "i": 10, "f": 1.0, "b": True, "e": "b", "l": ["ab", "cdef"], "d": {"x": 7}, "ds": [{"id": "q", "n": 0}], "req": "True"}, ["l: item failed pattern", "ds[2]: expected object"]),
        '{"i":"x","f":"y","b":"true","e":"zz","l":"q","d":[],"ds":{}}': (none, ["i: type coercion failed for 'int'", "f: type coercion failed for 'float'", "e: 'zz' not in enum", "l: expected list", "d: expected object", "ds: expected list", "req: missing required field"]),
        "[1]": (none, ["root: not an object"]), "nope": (none, ["root: invalid JSON"]), None: (none, ["root: invalid JSON"]),
        '{"i":5.9,"f":true,"l":[1,null,"a"],"ds":[{"id":"u","n":"w"}],"req":null}': (none | {"i": 5, "f": 1.0, "l": ["a"]}, ["l: item failed pattern", "l: item failed pattern", "req: missing required field"]),
        '{"i":-3.7,"s":1.5,"req":"r"}': (none | {"s": "1.5", "req": "r"}, []),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "j string").select("j", against(form, F.col("j")).alias("r")).collect()
    assert {r.j: (r.r.value.asDict(True), r.r.errors) for r in rows} == cases


def test_sinks_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 2} 10:00:00", "HIGH" if i % 3 else "LOW") for i in range(20)] + [(20, None, "LOW")], "seq long, t string, severity string")
    rows = rows.select("seq", F.col("t").cast("timestamp").alias("ts"), "severity")
    path = str(tmp_path / "sink")
    held = lambda: sorted((r.seq, str(r.day), r.severity) for r in spark.read.parquet(path).collect())
    verdicts.write_findings(rows, path)
    first = held()
    assert len(first) == 21
    verdicts.write_findings(rows, path)
    verdicts.write_findings(rows.where("severity = 'LOW'"), path)
    assert held() == first
    verdicts.write_findings(rows.limit(0), path)
    assert held() == first
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for checkpoint in ("one", "two"):  # the second run has lost its checkpoint and does the batch again
        verdicts.write_batches(stream, out, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 21


def test_nudge_says_why(spark):
    scored = spark.createDataFrame([("a", 5, True, 0.4, True, ["x"]), ("b", 3, False, 0.4, True, [])], "commandline string, severity int, is_malicious boolean, confidence double, abstained boolean, indicators array<string>")
    examples = spark.createDataFrame([("a", 2, True, None, 0.9), ("a", 1, False, None, 0.9)], "commandline string, rank int, label boolean, corrected_severity int, similarity double")
    got = {r.commandline: (r.severity, r.abstained, r.indicators) for r in verdicts.nudge(scored, examples, "commandline").collect()}
    assert got == {"a": (2, False, ["x", "Analyst-cleared a near-identical command as benign (sim=0.90)"]), "b": (3, True, [])}


def test_commands_by_context(spark):
    """A replication right by text, properties or object; a rule that raises; the same command in
    two contexts; hidden text; no command."""
    from threatlake.operators.heuristics import score_commands

    right = "{1131F6AA-9c07-11d1-f79f-00c04fc2dcd2}"
    rows = [
        (0, "dir", "4662", "u", right, None), (1, "dir", "1", "u", right, None), (2, "dir", "4662", None, "Replication rights", None), (3, "dir", "4662", "u", None, right),
        (4, f"x {right}", "1", "u", None, None), (5, "calc", "1", "u", None, None), (6, None, "4662", "u", right, None), (7, "dir", "1", "u", right, None),
        (8, "powershell -enc " + base64.b64encode("sekurlsa::x and more".encode("utf-16-le")).decode(), None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "seq long, commandline string, event_id string, user_name string, properties string, object_guid string")
    found = spark.createDataFrame([(5, 3, "R3", "HIGH"), (5, 1, "R1", "CRITICAL"), (5, 2, "R2", "LOW")], "seq long, rule_ord int, rule_name string, severity string")
    got = score_commands(frame, found).collect()
    assert len(got) == 7
    by = {(r.commandline, r.event_id, r.properties, r.object_guid): (r.matched_right, r.severity, r.heuristic, r.confidence, r.abstained, r.source) for r in got}
    used = "DS-Replication-Get-Changes"
    assert by["dir", "4662", right, None] == (used, 10, 1, 0.45, True, "dcsync") == by["dir", "4662", None, right]
    assert by["dir", "1", right, None] == (None, 1, 1, 0.7, False, "heuristic")
    assert by["dir", "4662", "Replication rights", None] == ("Replication rights", 10, 1, 0.45, True, "dcsync")
    assert by[f"x {right}", "1", None, None] == (used, 10, 1, 0.45, True, "dcsync")
    assert by["calc", "1", None, None] == (None, 10, 10, 0.8, False, "heuristic")
    assert next(r for r in got if r.commandline == "calc").indicators == ["Rule match: R1", "Rule match: R3"]
    hidden = next(r for r in got if r.decoded)
    assert (hidden.decoded, hidden.severity, hidden.techniques) == ("sekurlsa::x and more", 10, ["T1059.001", "T1003.001"])
    assert score_commands(frame.select("commandline")).count() == 4 and score_commands(frame.limit(0)).count() == 0


def test_first_report(spark):
    """Steps follow the phases; without hits there is one step, and lists keep their order."""
    from threatlake.operators.heuristics import NOTHING, PHASE_STEPS, SOMETHING, prescan

    schema = "seq long, ts timestamp, commandline string, event_id string, user_name string, hostname string, process_name string, parent_process_name string, properties string"
    rows = [(1, None, "dir", "1", "u", "h", "cmd", "", None), (2, datetime(2024, 1, 2), "amsiContext", "1", "u", "h", "cmd", "", None), (3, datetime(2024, 1, 1), "dir", "4662", "u", "h", "x", "", "replication")]
    got = prescan(spark.createDataFrame(rows, schema)).collect()
    of = lambda item: [(r.ord, r.value, r.n) for r in sorted(got, key=lambda r: r.ord) if r.item == item]
    assert of("overall_severity") == [(1, "critical", 2)] and sorted(of("phase")) == [(1, "Credential Access", 1), (1, "Defense Evasion", 1)]
    assert [v for _, v, _ in of("next_step")] == [SOMETHING, PHASE_STEPS["Credential Access"], PHASE_STEPS["Defense Evasion"]]
    assert [o for o, _, _ in of("next_step")] == [1, 2, 3]
    assert [(o, n) for o, _, n in of("finding")] == [(1, 10), (2, 10)] and of("finding")[1][1].startswith("3 AD Replication right: replication; ")
    assert [v for _, v, _ in of("timeline")] == ["2024-01-01 00:00:00 x h 4662", "2024-01-02 00:00:00 cmd h 1"]
    none = prescan(spark.createDataFrame([], schema)).collect()
    assert sorted((r.item, r.value) for r in none) == [("next_step", NOTHING), ("overall_severity", "clean")]
