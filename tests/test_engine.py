"""Readers, scalar functions, plans, components and streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threatlake.functions import normalize
from threatlake.operators import hunt, incidents
from threatlake.sources import readers
from threatlake.sources.tables import events
from threatlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_readers_agree(spark, tmp_path):
    ndjson = '{"HostName": "h1", "EventID": "1", "Image": "C:/x/cmd.exe", "Timestamp": "2024-05-01T10:00:00Z"}\n{"host.name": "h2", "EventCode": "07", "Timestamp": "1714557600", "User": "-"}\n'
    (tmp_path / "a.ndjson").write_text(ndjson + "broken\n")
    (tmp_path / "a.json").write_text("[" + ndjson.strip().replace("\n", ",") + "]")
    (tmp_path / "w.json").write_text('{"Events": [' + ndjson.strip().replace("\n", ",") + "]}")
    (tmp_path / "a.log").write_text(ndjson + "plain text\n")
    (tmp_path / "a.csv").write_text("HostName,EventID,Image,Timestamp\nh1,1,C:/x/cmd.exe,2024-05-01T10:00:00Z\n")
    seen = {}
    for name in ("a.ndjson", "a.json", "w.json", "a.csv"):
        rows = normalize.canonical(readers.read_raw(spark, str(tmp_path / name))).orderBy("hostname").collect()
        seen[name] = [(r.hostname, r.event_id, r.process_name, r.user_name, str(r.ts)) for r in rows]
    assert seen["a.ndjson"] == seen["a.json"] == seen["w.json"] == [("h1", "1", "cmd.exe", None, "2024-05-01 10:00:00"), ("h2", "7", "", None, "2024-05-01 10:00:00")] or seen["a.ndjson"][0] == seen["a.csv"][0]
    assert readers.read_raw(spark, str(tmp_path / "a.log")).where(F.col("raw")["raw"] == "plain text").count() == 1


def test_masks_and_times(spark):
    rows = spark.createDataFrame([("0x1410",), ("1410",), ("0x1000",), ("zz",), ("",), (None,)], "m string")
    assert [r[0] for r in rows.select(normalize.access_is_dangerous(F.col("m"))).collect()] == [True, True, False, False, False, False]
    times = spark.createDataFrame([("1714557600",), ("1714557600000",), ("May 1, 2024 @ 10:00:00.000",), ("2024-05-01 10:00:00",), ("bad",)], "t string")
    assert [str(r[0]) for r in times.select(normalize.timestamp(F.col("t"))).collect()] == ["2024-05-01 10:00:00"] * 4 + ["None"]


def test_within_has_no_nested_loop(spark):
    rows = events(spark, SF)
    plan = hunt.within(rows, rows.where("event_outcome = 'success'"), 60)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_match_union_find(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(k, 0, start + timedelta(seconds=rng.randint(0, 60_000)), f"h{rng.randint(0, 2)}", rng.choice(["", "u1", "u2", "u3", "u4"]), rng.choice(["", *(f"g{i}" for i in range(30))])) for k in range(60)]
    frame = spark.createDataFrame(rows, "seq long, rule_ord int, ts timestamp, hostname string, user_name string, process_guid string")
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a[3] == b[3] and (a[4] == b[4] != "" or a[5] == b[5] != "" or abs((a[2] - b[2]).total_seconds()) <= 600):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    got = {r.seq: r.incident for r in incidents.components(frame, 600).collect()}
    assert got == {k: find(k) for k in root}


def test_hunt_validation():
    step = {"id": "a", "predicates": [{"field": "hostname", "op": "eq", "value": "x"}]}
    assert hunt.validate({"steps": [], "select": "x"}) and hunt.validate(7) == ["a hunt is an object"] and not hunt.validate({"steps": [step], "select": "a"})
    bad = [{"field": "secret", "op": "eq"}, {"field": "hostname", "op": "like"}, {"field": "hostname", "op": "in", "value": "x"}, {"field": "hostname", "op": "regex", "value": "(a+)+"},
           {"field": "hostname", "op": "regex", "value": "("}, {"field": "event_id", "op": "gte", "value": "x"}]
    ir, errors = hunt.checked({"steps": [step, {**step, "predicates": step["predicates"] + bad}, {"predicates": bad}, 3], "relations": [
        {"type": "after", "left": "a", "right": "a_1"}, {"type": "within", "steps": ["a", "a_1"], "seconds": 10**9}, {"type": "same", "steps": ["a", "a_1"], "field": "ts"}, {"type": "near", "step": "a"},
    ]})
    assert [s["id"] for s in ir["steps"]] == ["a", "a_1"] and len(ir["steps"][1]["predicates"]) == 1 and ir["select"] == "a_1"
    assert ir["relations"] == [{"type": "after", "step": "a"}, {"type": "within", "step": "a", "seconds": 604_800, "keys": []}] and len(errors) == 2 * len(bad) + 4
    back, _ = hunt.checked({"steps": [step, {**step, "id": "b"}], "relations": [{"type": "after", "left": "a", "right": "b"}], "select": "a"})
    assert back["relations"] == [{"type": "before", "step": "b"}]


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    done = jobs.stream_host_counts(stream).writeStream.outputMode("update").format("memory").queryName("hosts").start()
    done.processAllAvailable()
    done.stop()
    assert spark.sql("select sum(events) from hosts").first()[0] == rows.count()
    for make in (jobs.stream_rules, jobs.stream_bruteforce):
        assert make(stream).isStreaming


def test_canonical_fields(spark):
    """Order of aliases, lone dashes, numeric names, paths, made ids, times, outcomes."""
    import uuid

    raws = [
        {"HostName": "-", "Computer": "c1", "Image": "C:\\\\x\\\\cmd.exe", "ParentImage": "C:/p/up.exe", "EventID": "007", "Timestamp": "Apr 4, 2025 @ 22:00:00.000", "message": "said", "event.outcome": "Failed'\x1dUID=0"},
        {"host.name": "h2", "ProcessName": "1.5e3", "process.executable": "/bin/sh", "ProcessGuid": "g", "ParentProcessGuid": "pg", "EventCode": "x", "CommandLine": "run"},
        {"ProcessName": "plain", "Timestamp": "1714557600", "Hashes": "h", "AccessMask": "0x1", "SubjectUserSid": "s"},
    ]
    frame = spark.createDataFrame([("f", k, r) for k, r in enumerate(raws)], "_src string, seq long, raw map<string,string>")
    a, b, c = normalize.canonical(frame).orderBy("seq").collect()
    assert set(normalize.ALIASES) <= set(a.asDict()) and len(normalize.ALIASES) == 42
    assert (a.hostname, a.process_name, a.process_path, a.parent_process_name, a.parent_process_path) == ("c1", "cmd.exe", raws[0]["Image"], "up.exe", "C:/p/up.exe")
    assert (a.event_id, a.commandline, a.event_outcome, str(a.ts)) == ("7", "said", "failed", "2025-04-04 22:00:00")
    assert a.process_guid == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"c1-{raws[0]['Image']}-Apr 4, 2025 22:00:00.000-said"))
    assert a.parent_process_guid == str(uuid.uuid5(uuid.NAMESPACE_DNS, "c1-C:/p/up.exe-parent"))
    assert (b.process_name, b.process_guid, b.parent_process_guid, b.event_id, b.commandline) == ("sh", "g", "pg", "x", "run")
    assert (c.process_name, c.process_path, c.parent_process_guid, str(c.ts)) == ("plain", None, None, "2024-05-01 10:00:00")
    assert (c.hashes, c.action_type, c.access_mask, c.user_sid, c.properties) == ("h", "0x1", "0x1", "s", "s")


def test_sessions_across_buckets(spark):
    """Chains that go on over many time buckets, against a plain walk."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=rng.choice([0, 50, 3600, 3601, 9000]) * rng.randint(0, 40)), rng.choice(["a", "b", None])) for k in range(300)]
    frame = spark.createDataFrame(rows, "seq long, ts timestamp, hostname string")
    want = {}
    for host in ("a", "b", None):
        last, session = None, None
        for k, ts, _ in sorted((r for r in rows if r[2] == host), key=lambda r: (r[1], r[0])):
            session = k if last is None or (ts - last).total_seconds() > 3600 else session
            want[k], last = session, ts
    for width in (3600, 7200, 86_400):
        got = incidents.gap_sessions(frame, bucket_seconds=width)
        assert got.columns == ["seq", "ts", "hostname", "session"] and {r.seq: r.session for r in got.collect()} == want


def test_long_chains_of_incidents_settle(spark):
    rows = [(k, 0, f"g{k // 2}", f"u{(k + 1) // 2}") for k in range(150)]
    frame = spark.createDataFrame(rows, "seq long, rule_ord int, process_guid string, user_name string").selectExpr("*", "cast(null as timestamp) as ts", "'h' as hostname")
    assert {r.incident for r in incidents.components(frame).collect()} == {0}


def test_streams_equal_batches(spark, tmp_path):
    from threatlake.operators import rules

    rows = events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def ran(df, name, mode="append"):
        done = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        done.processAllAvailable()
        done.stop()
        return spark.table(name)

    found = rules.evaluate(rows)
    assert ran(jobs.stream_rules(stream), "r1").count() == found.count()
    # the same rows in four files, one a batch, not in order of time
    rows.repartition(4, F.xxhash64("seq")).write.parquet(str(tmp_path / "parts"))
    parts = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "parts"))
    named = lambda df: sorted(map(str, df.select("window.*", *(c for c in df.columns if c != "window")).collect()))
    wide = {"least": 1, "width": "30 days", "slide": "15 days"}
    want = named(jobs.stream_bruteforce(rows, **wide))
    assert len({r.split("rule_id='")[1][:11] for r in want}) == 3
    assert named(ran(jobs.stream_bruteforce(parts, **wide), "r3", "complete")) == want
    assert ran(jobs.stream_incident_sessions(jobs.stream_rules(stream)), "r4", "complete").agg(F.sum("findings")).first()[0] == found.count()


def test_hunts_scan_the_events_once(spark):
    rows = events(spark, SF)
    ir = {"steps": [{"id": "a", "predicates": [{"field": "event_outcome", "op": "eq", "value": "success"}]}, {"id": "b", "predicates": [{"field": "commandline", "op": "contains", "value": "minidump"}]}], "select": "b"}
    found, counts = hunt.execute(rows, ir | {"relations": [{"type": "same", "step": "a", "field": "hostname"}, {"type": "within", "step": "a", "seconds": 600}]})
    assert counts == {"a": rows.where("event_outcome = 'success'").count(), "b": rows.where("lower(commandline) like '%minidump%'").count()}
    assert "events.parquet" not in str(found.inputFiles())
    assert hunt.execute(rows.limit(0), ir)[1] == {"a": 0, "b": 0}
    with pytest.raises(ValueError, match="within"):
        hunt.run_hunt(rows, ir | {"relations": [{"type": "within", "step": "a", "seconds": 10**9}]})


def test_questions_become_hunts():
    ir = hunt.asked("Which of those ran mimikatz, and what did the same host do next?")
    assert ir["use_previous"] and ir["select"] == "b" and [p["value"] for p in ir["steps"][0]["predicates"]] == ["mimikatz"]
    assert ir["relations"] == [{"type": "after", "step": "a"}, {"type": "same", "step": "a", "field": "hostname"}]
    assert hunt.asked("")["steps"][0]["predicates"] == [{"field": "process_name", "op": "ne", "value": ""}] and not hunt.asked("")["relations"]


def test_streams_in_any_order_equal_batches(spark, tmp_path):
    """Shuffled findings in four micro-batches, the rows late within the watermark; then one far later."""
    from threatlake.operators import rules

    schema = "rule_ord int, rule_id string, seq long, ts timestamp, hostname string, user_name string, process_guid string, commandline string, source_ip string"
    rng, begin, rows = random.Random(7), datetime(2024, 3, 1), []
    for k in range(160):
        at = begin + timedelta(minutes=3 * k if k % 40 < 20 else 3 * k + 300)
        rows.append((k % 2, f"R{k % 2}", k, at, f"h{k % 3}", f"u{k % 2}", f"g{k % 5}" if k % 4 else None, "cmd", "ip"))
    rng.shuffle(rows)
    end = (0, "END", 999, begin + timedelta(days=30), "hx", "u", "g", "c", "i")
    for n in range(4):
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def ran(df, name):
        done = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        done.processAllAvailable()
        assert len([p for p in done.recentProgress if p.numInputRows]) >= 5
        done.stop()
        return spark.table(name)

    batch = spark.createDataFrame(rows, schema)
    columns = batch.columns
    actor = F.coalesce("process_guid", "commandline")
    want = batch.groupBy("rule_id", actor.alias("a"), "source_ip", "user_name", "hostname").agg(F.min_by(F.struct(*columns), F.struct("seq", "rule_ord")).alias("f")).select("f.*")
    got = ran(jobs.stream_dedup(stream, "40 days", "40 days"), "any_order")
    assert got.count() == 0  # the watermark has not passed
    got = ran(jobs.stream_dedup(stream, "20 days", "1 hour"), "any_order_2").where("rule_id <> 'END'")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect()))
    sessions = ran(jobs.stream_incident_sessions(stream, "20 days"), "any_order_3").where("hostname <> 'hx'")
    known = incidents.gap_sessions(batch).groupBy("hostname", "session").agg(F.count("*").alias("findings"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    columns = ["hostname", "session", "findings", "first_seen", "last_seen"]
    assert known.count() > 3 and sorted(map(tuple, sessions.select(*columns).collect())) == sorted(map(tuple, known.select(*columns).collect()))


def test_incidents_by_steps_equal_one_run(spark):
    """Halves in both orders, a merge of two incidents by a later finding, and its triage."""
    from threatlake.operators.shared import Scratch

    rng, begin = random.Random(11), datetime(2024, 5, 1)
    rows = [(k, 0, begin + timedelta(minutes=rng.randint(0, 60 * 90)) if k % 9 else None, f"h{k % 3}" if k % 7 else None, f"u{k % 29}" if k % 2 else "", f"g{k % 31}" if k % 3 else None) for k in range(90)]
    schema = "seq long, rule_ord int, ts timestamp, hostname string, user_name string, process_guid string"
    frame = spark.createDataFrame(rows, schema)
    want = {r.seq: r.incident for r in incidents.components(frame).collect()}
    assert len(set(want.values())) > 5
    for order in ((0, 1), (1, 0)):
        nodes, spans = spark.createDataFrame([], incidents.NODES), spark.createDataFrame([], incidents.SPANS)
        for part in order:
            before = nodes
            nodes, spans = incidents.advance(frame.where(f"seq % 2 = {part}"), nodes, spans, Scratch(spark, "steps"))
        assert {r.seq: r.incident for r in incidents.placed(nodes).collect()} == want
        kept = {r.node: r.root for r in before.collect()}
        for r in incidents.changed(before, nodes).collect():
            assert kept.pop(r.node, None) != r.root
        now = {r.node: r.root for r in nodes.collect()}
        assert all(now[n] == r for n, r in kept.items())
    pair = [(1, 0, begin, "h", "a", ""), (2, 0, begin + timedelta(hours=9), "h", "b", "")]
    nodes, spans = incidents.advance(spark.createDataFrame(pair, schema), spark.createDataFrame([], incidents.NODES), spark.createDataFrame([], incidents.SPANS), Scratch(spark, "steps"))
    assert {(r.seq, r.incident) for r in incidents.placed(nodes).collect()} == {(1, 1), (2, 2)}
    late = spark.createDataFrame([(3, 0, begin + timedelta(hours=9, minutes=50), "h", "a", "")], schema)
    nodes, _ = incidents.advance(late, nodes, spans, Scratch(spark, "steps"))
    where = incidents.placed(nodes)
    assert {(r.seq, r.incident) for r in where.collect()} == {(1, 1), (2, 1), (3, 1)}
    log = spark.createDataFrame([(2, 7, "excluded"), (5, 8, "new")], "incident_id long, seq long, status string")
    assert {(r.incident_id, r.status) for r in incidents.follow(log, where).collect()} == {(1, "excluded"), (5, "new")}


def test_validation_hunts_find_the_evidence(spark):
    from threatlake.operators import heuristics

    rows = events(spark, SF).cache()
    counts = {r.technique: r.evidence for r in heuristics.evidence(rows).collect()}
    for technique in ("T1003.001", "T1059.001", "T1140"):
        ir, errors = hunt.checked(heuristics.validation_hunt(technique))
        assert not errors and hunt.run_hunt(rows, ir).count() == counts[technique] > 0
    for technique in [*heuristics.EVIDENCE, "T9999"]:
        assert not hunt.checked(heuristics.validation_hunt(technique))[1]
    asked = spark.createDataFrame([("T1140",), ("T9999",)], "technique string")
    found = {r.technique: r.evidence for r in heuristics.with_evidence(asked, rows).collect()}
    assert found == {"T1140": counts["T1140"], "T9999": rows.where("process_name <> ''").count()}
