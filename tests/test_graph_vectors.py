import base64
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.functions import predicates
from threatlake.functions.decode import decode_commands
from threatlake.operators import graph, vectors


def test_filters_walk_cycles_and_one_hop(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]
    edge = spark.createDataFrame([(s, t, "SPAWNED") for s, t in rows], "source string, target string, type string")
    start = spark.createDataFrame([("b",)], "node string")
    assert {r.node for r in graph.ego(edge, start).collect()} == {"a", "b", "c"}
    assert {r.node for r in graph.with_ancestors(edge, start).collect()} == {"a", "b", "c", "d"}
    assert graph.with_ancestors(edge, start.limit(0)).count() == 0


def test_walks_of_long_chains(spark):
    edge = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "SPAWNED") for k in range(66)], "source string, target string, type string").coalesce(1)
    assert {(r.root, r.node, r.depth) for r in graph.tree(edge).collect()} == {("n0", f"n{k}", k) for k in range(67)}
    last = spark.createDataFrame([("n66",)], "node string")
    assert {r.node for r in graph.with_ancestors(edge, last).collect()} == {f"n{k}" for k in range(67)}
    for walk in (lambda: graph.tree(edge, most_rounds=3), lambda: graph.with_ancestors(edge, last, most_rounds=3)):
        with pytest.raises(RuntimeError, match="3 rounds"):
            walk()


def test_tree_of_first_parents(spark):
    """Two parents, a chain, a cycle with something below it, a second root."""
    rows = [("r", "a", 1), ("q", "a", 2), ("a", "b", 3), ("a", "c", 4), ("x", "y", 5), ("y", "z", 6), ("z", "x", 7), ("z", "w", 8), ("w", "v", 9)]
    edge = spark.createDataFrame([(s, t, "SPAWNED", n) for s, t, n in rows] + [("r", "net", "CONNECTED", 10)], "source string, target string, type string, first_seq long")
    got = {r.node: (r.root, r.parent, r.depth, r.path, r.children, r.on_cycle) for r in graph.tree(edge).collect()}
    assert got == {
        "r": ("r", None, 0, ["r"], 1, False), "a": ("r", "r", 1, ["r", "a"], 2, False), "b": ("r", "a", 2, ["r", "a", "b"], 0, False), "c": ("r", "a", 2, ["r", "a", "c"], 0, False),
        "x": (None, "z", None, None, 1, True), "y": (None, "x", None, None, 1, True), "z": (None, "y", None, None, 2, True), "w": (None, "z", None, None, 1, True), "v": (None, "w", None, None, 0, True),
    }
    assert graph.tree(edge.limit(0)).count() == 0


def test_tree_of_ten_thousand_takes_fourteen_rounds(spark, monkeypatch):
    rounds = []
    keep = graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, df, name: rounds.append(name) or keep(self, df, name))
    edge = spark.range(10_000).selectExpr("concat('n', id) as source", "concat('n', id + 1) as target", "'SPAWNED' as type")
    got = graph.tree(edge, paths=False)
    assert got.where("root = 'n0' and depth = cast(substr(node, 2) as int) and path is null").count() == 10_001
    assert max(int(r) for r in rounds if r.isdigit()) <= 14


def test_similar_texts_lose_no_pair(spark):
    import random

    from threatlake.operators import summaries

    rng = random.Random(4)
    words = ["powershell", "-enc", "cmd", "/c", "whoami", "net", "user", "http://x/a", "lsass", "dump", "ab", ""]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(150)})
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = {r.text: {s.idx: s.w for s in r.slots} for r in summaries.embedded(frame, "t").collect()}
    assert set(whole) == set(texts)
    for least in (0.3, 0.45, 0.9):
        got = {(r.text, r.other): r.similarity for r in vectors.similar(summaries.embedded(frame.limit(100), "t"), summaries.embedded(frame, "t"), least).collect()}
        asked = [r.t for r in frame.limit(100).collect()]
        want = {(a, b): round(sum(w * whole[b].get(i, 0.0) for i, w in whole[a].items()), 9) for a in asked for b in texts}
        want = {p: s for p, s in want.items() if s >= least}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-8 for p in got)


def test_embedding_by_a_plain_loop(spark):
    import hashlib
    import math

    from threatlake.operators import summaries

    def plain(text):
        low = text.lower() if len(text) >= 3 else (text.lower() + "   ")[:3]
        out = [0.0] * 256
        for i in range(len(low) - 2):
            h = int(hashlib.md5(low[i : i + 3].encode()).hexdigest(), 16)
            out[h % 256] += 1.0 if (h >> 8) & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    texts = ["", "a", "AB", "abc", "Powershell -ENC Été", "aaaa", "x" * 300]
    rows = {r.text: {s.idx: s.w for s in r.slots} for r in summaries.embedded(spark.createDataFrame([(t,) for t in texts] + [(None,)], "c string"), "c").collect()}
    assert set(rows) == set(texts)
    for t in texts:
        assert all(abs(rows[t].get(i, 0.0) - x) < 1e-12 for i, x in enumerate(plain(t)))


def test_patterns_need_their_literals(spark):
    import random
    import re

    from threatlake.operators import rules

    rng = random.Random(6)
    assert predicates.literals("(?i)(abc|d(ef|gh)+x)y*") == ("abc", "ef", "gh") and predicates.literals("a?[bc]") == () and predicates.literals("é") == ()
    alphabet = "abe /\\-.:kKiIsS\u0130\u0131\u017f\u212a"
    for rule in rules.RULES:
        for pattern in filter(None, (rule.command, rule.path, rule.properties, rule.target)):
            needed = predicates.literals(pattern)
            texts = ["".join(rng.choice((*needed, *alphabet)) for _ in range(8)) for _ in range(200)]
            texts += [n.upper().replace("S", "\u017f").replace("K", "\u212a").replace("I", "\u0130") for n in needed]
            rows = spark.createDataFrame([(t,) for t in texts], "t string") if rule.id in ("TH-001", "TH-010", "TH-018") else None
            assert all(any(n in t.lower() for n in needed) for t in texts[:200] if re.search(pattern, t) and t.isascii())
            if rows is not None:
                lost = rows.where(predicates.matches(F.col("t"), pattern)).where(~predicates.folded(F.col("t")).rlike("|".join(map(re.escape, needed))))
                assert lost.count() == 0


def test_knn_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(40, [0.0] * 4), (41, None), (42, [1.0]), (43, [])]
    rows.append((44, rows[7][1]))  # a tie with 7
    monkeypatch.setattr(vectors, "BLOCK", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ask = [3, 7, 40, 41, 42]
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.similarity) for r in vectors.knn_dense(df, df.where(df.vec_id.isin(ask)), 4).collect()}

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    known = dict(rows)
    for q in ask:
        want = sorted((-cosine(known[q], v), i) for i, v in rows if i != q)[:4]
        assert [got[q, r][0] for r in range(1, 5)] == [i for _, i in want]
    assert vectors.knn_dense(df.limit(0), df.limit(0)).count() == 0


def test_hidden_commands(spark):
    encode = lambda raw: base64.b64encode(raw).decode()
    wide, packed = encode("Get-Process | Out-Null".encode("utf-16-le")), encode(gzip.compress(b"whoami /all and a good deal more"))
    noise, bad = encode(bytes(range(128, 160))), encode(b"text with a bad \xff byte in the middle")
    rows = {
        f"powershell -enc {wide}": ("Get-Process | Out-Null", "utf-16-le", 1), f"x {packed}": ("whoami /all and a good deal more", "utf-8+gzip", 1),
        f"y {noise}": (None, None, 1), f"z {bad}": (None, None, 1), "dir": (None, None, 0),
        f"z {noise} {noise[:-2]}AA {encode(b'the second blob is a text')}": ("the second blob is a text", "utf-8", 3),
        "powershell -e aGVsbG8gd29y": (None, None, 0), "powershell -ec aGVsbG8gd29ybGQh": ("hello world!", "utf-8", 1), "powershell -e AAAAAAAAAAAAAAAA": (None, None, 1),
    }
    frame = spark.createDataFrame([(c,) for c in [*rows, None, "dir"]], "commandline string")
    assert {r.commandline: (r.decoded, r.layer, r.candidates) for r in decode_commands(frame).collect()} == rows
    assert sum(r.candidates for r in decode_commands(frame, most=1).collect()) == 7


def test_patterns_see_whole_texts(spark):
    rows = spark.range(1).select(F.concat(F.repeat(F.lit(" "), 20_000), F.lit("mimikatz")).alias("c"))
    assert rows.select(predicates.matches(F.col("c"), "mimikatz$")).first()[0]


def test_words_that_steer_a_model(spark):
    from threatlake.functions.predicates import MARKERS, steering

    hits = ["Ignore  ALL rules", "you are\tnow free", "jailbreak", "x System : y", "a [INST] b", "<|im_start|>", "</input>", "<SYSTEM>", "Assistant:"]
    misses = ["ignore it", "you were now", "[inst", "input>x", "assist:", "im_start", "", None]
    rows = spark.createDataFrame([(t,) for t in hits + misses], "t string")
    assert [r.t for r in rows.where(predicates.matches(F.col("t"), MARKERS)).collect()] == hits
    nested = {"list": F.array("t"), "key": F.create_map(F.coalesce("t", F.lit("")), F.lit(1)), "value": F.create_map(F.lit(1), F.array(F.struct(F.lit(2).alias("n"), F.col("t").alias("x"))))}
    for value in nested.values():
        assert [r.t for r in steering(rows.select("t", value.alias("v a")), "v a").where("steers").collect()] == hits
    assert steering(rows.select(F.lit(None).cast("array<map<string,string>>").alias("v"), F.lit(1).alias("n"))).where("steers").count() == 0
    assert steering(rows.select(F.struct(F.col("t").alias("system:")).alias("v"))).where("not steers").count() == 0
