"""What keeps the work of queries in proportion to their input."""

import base64
import random

from pyspark.sql import functions as F

from threatlake.functions.decode import decode_blob, decode_commands
from threatlake.operators import incidents, verdicts
from threatlake.operators.shared import Scratch


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_blob_is_decoded_once(spark):
    """Each step of decoding stands once in the plan, and gives what Python gives."""
    rng, texts = random.Random(5), ["plain text", "größer, ça va", "\U0001f602 laugh", "\0zero\0", "ØßØ x", "ab"]
    raw = [(t * 9).encode(c) for t in texts for c in ("utf-8", "utf-16-le")]
    raw += [b"".join(rng.choice((b"a\0", b"b\0", b"\0\xd8", b"\0\xdc", b"\x3d\xd8\x02\xde")) for _ in range(n)) for n in (8, 12, 40, 80) for _ in range(12)]
    raw += [b"ab\0" * 7, b"a\0" * 20 + b"x", b"a\0" * 30 + b"\0\xdc", b"a\0" * 30 + b"\0\xd8"]
    blobs = {b.decode(): decode_blob(b) for b in map(base64.b64encode, raw)}
    found = decode_commands(spark.createDataFrame([(f"x -enc {b}",) for b in blobs], "commandline string"))
    assert {r.commandline[7:]: (r.decoded, r.layer) if r.layer else None for r in found.collect()} == blobs
    assert sum(v is None for v in blobs.values()) > 5 and plan(found.select(F.length("decoded"))).count("unbase64(") == 1


def test_a_verdict_is_parsed_once(spark):
    rows = spark.range(3).selectExpr("""'{"severity": ' || id || ', "attack_stage": "Execution"}' as json""")
    for found in (verdicts.validate(rows), verdicts.validate_session(rows)):
        assert plan(found.drop("json").select("source", "valid", "errors")).count("parseJson(") <= 2
    assert plan(verdicts.validate_session(rows)).count("parseJson(") == 1


def test_rounds_see_no_findings(spark, monkeypatch):
    """A thousand findings of one host, user and process: the rounds get two links, not three for each."""
    seen, whole = [], incidents.connected
    monkeypatch.setattr(incidents, "connected", lambda edges, *more: seen.append(edges.where("a <> b").distinct().count()) or whole(edges, *more))
    rows = spark.range(1000).selectExpr("id as seq", "0 as rule_ord", "timestamp'2024-05-01 10:00:00' as ts", "'h' as hostname", "'u' as user_name", "'g' as process_guid")
    nodes, _ = incidents.advance(rows, spark.createDataFrame([], incidents.NODES), spark.createDataFrame([], incidents.SPANS), Scratch(spark, "leaves"))
    assert seen == [2]
    assert {(r.incident, r.n) for r in incidents.placed(nodes).groupBy("incident").agg(F.count("*").alias("n")).collect()} == {(0, 1000)}
